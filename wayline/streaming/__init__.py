"""Structured Streaming forms of operators with bounded state."""
