"""Token-sequence analytics on Spark DataFrames."""
