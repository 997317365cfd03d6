"""keystrand: keyed event-log analytics on PySpark DataFrames and Structured Streaming."""
