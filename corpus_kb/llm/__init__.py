"""Operators and queries of a training-data pipeline; nothing outside imports this subpackage."""
