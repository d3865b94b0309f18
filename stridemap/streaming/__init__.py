"""Structured Streaming forms of the operators that carry state from record to record."""
