"""Structured Streaming forms of the interaction graphs."""
