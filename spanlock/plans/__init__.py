"""Plans of the span-commitment engine."""
