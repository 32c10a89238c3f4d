"""Structured Streaming twins of the event operators: unbounded input, bounded state."""
