"""Change-data engine on Spark DataFrames."""
