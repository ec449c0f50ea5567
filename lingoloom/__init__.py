"""A PySpark-native engine for human-in-the-loop machine translation data."""
