"""Note-vault analytics on Spark DataFrames."""
