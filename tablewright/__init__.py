"""Tabular analytics and feature engineering as Spark DataFrame operators."""

__version__ = "0.1.0"
