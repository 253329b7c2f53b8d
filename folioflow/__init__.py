"""folioflow: document analytics on Spark DataFrames."""
