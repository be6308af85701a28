"""A PySpark-native engine for seasonal greenness time series."""

__version__ = "0.1.0"
