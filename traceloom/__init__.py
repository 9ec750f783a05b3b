"""Spark-native analytics for manufacturing traceability data."""
