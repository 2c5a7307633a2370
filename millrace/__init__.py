"""millrace: a PySpark-native engine for environmental series, evaluation and data quality."""

__version__ = "0.1.0"
