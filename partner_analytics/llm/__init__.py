"""Operators of a training-data pipeline, each in its own module, and their registered queries."""
