"""Long-read gap analytics on Spark DataFrames."""
