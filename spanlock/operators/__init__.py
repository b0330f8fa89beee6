"""Operators of the span-commitment engine."""
