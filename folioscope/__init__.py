"""PySpark-native analytics over document corpora."""
