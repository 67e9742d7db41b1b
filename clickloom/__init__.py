"""Behaviour features and recommendation analytics as Spark DataFrame functions."""

__version__ = "0.1.0"
