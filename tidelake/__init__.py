"""A Spark-native engine for versioned, long-format observations."""
