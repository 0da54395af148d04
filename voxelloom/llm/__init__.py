"""Operators of a training-data pipeline; nothing else in the package imports this subpackage."""
