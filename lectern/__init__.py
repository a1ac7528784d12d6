"""lectern: a PySpark-native analytics library for media-catalogue data."""
