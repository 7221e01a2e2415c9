"""hopweave: link-graph analytics on Spark DataFrames."""
