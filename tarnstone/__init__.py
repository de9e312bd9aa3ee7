"""Document retrieval and evaluation on Spark: admission, parsing, chunking, hybrid search, evaluation."""
