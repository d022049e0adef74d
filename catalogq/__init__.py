"""catalogq: a PySpark-native engine for auditing and curating catalogue and review data."""

__version__ = "0.1.0"
