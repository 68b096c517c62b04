"""quillmill: retrieval, content analytics and training-data operators on Spark DataFrames."""
