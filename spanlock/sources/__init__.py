"""Sources of the span-commitment engine."""
