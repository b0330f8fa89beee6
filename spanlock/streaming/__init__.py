"""Streaming of the span-commitment engine."""
