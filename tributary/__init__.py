"""Tributary: column lineage and training-data operators, declared as Spark plans."""

__version__ = "0.1.0"
