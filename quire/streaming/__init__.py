"""Documents and run logs as they arrive, by Structured Streaming."""
