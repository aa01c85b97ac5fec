"""A Spark-native analytics engine for large tables of embedding vectors and their metadata."""
