"""Structured Streaming twins of the trace, log and snapshot jobs."""
