"""millrace: a Spark-native analytics and learning engine."""

__version__ = "0.1.0"
