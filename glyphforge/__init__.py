"""Glyphforge: a Spark-native engine for orthography, phonology and text corpora."""

__version__ = "0.1.0"
