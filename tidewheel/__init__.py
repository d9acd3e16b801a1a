"""tidewheel: Spark-native analytics over temporal networks and cross-sectional panels."""

__version__ = "0.1.0"
