"""A PySpark-native analytics engine for commodity signals and news."""
