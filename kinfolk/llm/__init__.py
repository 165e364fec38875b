"""Operators of a training-data pipeline: one module per operator, `queries` binds them to the tables."""
