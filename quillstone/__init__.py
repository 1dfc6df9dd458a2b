"""quillstone: schema-driven entities, queried and changed as Spark DataFrames."""
