"""segmill: a PySpark-native engine for object-mask pseudo-label tables."""
