"""isobath: Spark-native analytics for daily gridded and regional time series."""

__version__ = "0.1.0"
