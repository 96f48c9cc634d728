"""A PySpark-native vector-search and keyed-table engine."""

__version__ = "0.1.0"
