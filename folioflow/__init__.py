"""Page-collection analytics on Spark DataFrames."""
