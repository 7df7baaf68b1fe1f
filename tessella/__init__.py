"""tessella: structural-evidence analytics on Spark DataFrames."""
