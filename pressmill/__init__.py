"""A PySpark-native content-curation analytics engine."""
