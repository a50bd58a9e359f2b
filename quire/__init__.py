"""quire: document-unit analytics on Spark DataFrames."""
