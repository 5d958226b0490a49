"""Whole ways: the engine and the registered queries."""
