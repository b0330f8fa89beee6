"""Span-commitment analytics on Spark."""
