"""tallframe: Spark-native numerical analysis of tall tables."""

__version__ = "0.1.0"
