"""PySpark-native data skipping with stripe indexes."""
