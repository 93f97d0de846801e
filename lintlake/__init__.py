"""A PySpark-native engine that treats source code, and training text, as data."""
