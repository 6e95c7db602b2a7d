"""Retail sales, customer feedback and agent-trace analytics as PySpark DataFrame jobs."""

__version__ = "0.1.0"
