"""Code-corpus, retrieval and training-data analytics expressed as Spark DataFrame operators."""
