"""Robust analytics over repeated measurements of one grid, as Spark DataFrame operators."""

__version__ = "0.1.0"
