"""Operators of a training-data pipeline over text, conversations, pages and vectors."""
