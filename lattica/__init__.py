"""lattica: graph-enhanced retrieval analytics on Spark DataFrames."""
