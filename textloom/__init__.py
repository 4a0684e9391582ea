"""Text retrieval and theme analytics on Spark DataFrames."""
