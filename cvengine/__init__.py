"""Customer-value analytics on Spark DataFrames."""
