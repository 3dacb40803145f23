"""Behavioural analytics over activity logs on Spark."""

__version__ = "0.1.0"
