"""A Spark-native engine for scanning flat, strictly typed tables."""
