"""docframe: semi-structured records as Spark DataFrames."""
