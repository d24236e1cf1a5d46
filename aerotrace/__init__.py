"""Spark operators for aerial search missions: tables in, tables out."""

__version__ = "0.1.0"
