"""tidemark: a Spark-first analytics engine for market time series, events and text corpora."""

__version__ = "0.1.0"
