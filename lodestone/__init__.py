"""Lodestone: a PySpark-native document and package analytics engine."""

__version__ = "0.1.0"
