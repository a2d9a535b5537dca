"""siltscope: a PySpark-native analytics engine for source code and text corpora."""

__version__ = "0.1.0"
