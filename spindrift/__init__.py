"""spindrift: a Spark-native analytics engine for source repositories and document collections."""

__version__ = "0.1.0"
