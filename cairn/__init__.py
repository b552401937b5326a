"""cairn: retrieval, extraction and claim analytics over text memories, as Spark DataFrame pipelines."""
