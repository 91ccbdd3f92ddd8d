"""folioflow: incremental document processing on Spark DataFrames."""
