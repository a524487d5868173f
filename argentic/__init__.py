"""A Spark-native engine for media catalogues."""
