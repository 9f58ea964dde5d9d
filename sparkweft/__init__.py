"""A Spark-native engine for co-occurrence graphs, retrieval and ranking."""
