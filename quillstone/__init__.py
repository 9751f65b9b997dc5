"""quillstone: a Spark-native engine for document collections, retrieval and answer checking."""
