"""textloom: a Spark-first engine for preparing and analysing multilingual text corpora."""

__version__ = "0.1.0"
