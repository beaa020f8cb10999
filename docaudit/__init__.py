"""Schema-driven document validation and audit analytics on Spark DataFrames."""
