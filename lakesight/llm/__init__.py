"""Operators and queries of a training-data pipeline."""
