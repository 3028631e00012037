"""millrace: document-pipeline analytics on Spark DataFrames."""
