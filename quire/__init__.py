"""Quire: analytics over long structured documents, on Spark DataFrames."""
