"""A Spark-native engine for vector search, index pairing and the analytics around them."""
