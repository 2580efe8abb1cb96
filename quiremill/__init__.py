"""quiremill: a PySpark-native engine for building and querying literary text corpora."""

__version__ = "0.1.0"
