"""A PySpark-native engine for data pipelines whose operators include model calls."""
