"""Tidemark: point-in-time time-series analytics on Spark DataFrames."""
