"""Functions of the span-commitment engine."""
