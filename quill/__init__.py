"""quill: analytics, retrieval and corpus preparation over Spark DataFrames."""
