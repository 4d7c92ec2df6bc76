"""A PySpark-native engine for bibliographic records."""
