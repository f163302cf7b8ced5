"""Contract-coverage analytics on Spark DataFrames."""
