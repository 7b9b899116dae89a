"""loomstead: a Spark-native engine for text collections, hybrid retrieval and corpus preparation."""

__version__ = "0.1.0"
