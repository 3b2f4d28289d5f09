"""A PySpark-native engine for labelled multi-dimensional numeric data."""
