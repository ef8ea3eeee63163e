"""sentispark: measure public sentiment in posts with Spark DataFrames and streams."""

__version__ = "0.1.0"
