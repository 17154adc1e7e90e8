"""Time-series feature extraction, processing and chunking as Spark plans."""

__version__ = "0.1.0"
