"""Structured Streaming forms of the operations."""
