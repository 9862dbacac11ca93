"""A Spark-native analytics engine for code-symbol graphs."""
