"""tilescape: Spark-native analytics for tiled images and their embedding vectors."""

__version__ = "0.1.0"
