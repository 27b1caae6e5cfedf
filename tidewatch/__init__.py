"""PySpark-native environmental stress analytics."""
