"""sparklog: Spark-native security-log analytics."""
__version__ = "0.1.0"
