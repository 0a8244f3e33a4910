"""Streaming forms of operators that a stream can feed."""
