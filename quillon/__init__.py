"""Statistical text analytics on Spark DataFrames."""
