"""A PySpark-native engine for vector search and the analytics around it."""
