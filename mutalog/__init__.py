"""Versioned key-value analytics on Spark: an append-only mutation log read as DataFrames."""
