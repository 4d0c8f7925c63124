"""Structured Streaming forms of the operators that work record by record."""
