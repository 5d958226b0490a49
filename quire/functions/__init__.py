"""Functions that Spark lacks."""
