"""A PySpark-native full-text search and analytics engine."""
