"""Operators of a training-data pipeline, on the tables of documents and conversations."""
