"""Operators of a training-data pipeline, their queries and SQL; nothing else in the library imports this."""
