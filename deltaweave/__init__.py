"""deltaweave: incremental analytics on Spark DataFrames."""
