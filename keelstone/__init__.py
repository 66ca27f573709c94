"""Typed key-value, event-stream and vector analytics on Spark DataFrames."""
