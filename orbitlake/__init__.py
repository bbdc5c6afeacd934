"""A Spark-native engine for molecular frames and the tables around them."""

__version__ = "0.1.0"
