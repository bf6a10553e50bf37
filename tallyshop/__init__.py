"""Retail analytics on Spark: tables, marts, analyses, features and forecasts."""

__version__ = "0.1.0"
