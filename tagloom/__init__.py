"""A PySpark-native analytics engine for label-recognition data."""
