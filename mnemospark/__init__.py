"""Memory and knowledge analytics on Spark DataFrames."""
