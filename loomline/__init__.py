"""Factory-floor analytics on PySpark DataFrames and Structured Streaming."""
