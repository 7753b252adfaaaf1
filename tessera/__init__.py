"""A PySpark-native engine for collection-oriented document and graph queries."""
