"""Queries over the given tables, one per operator, with the same result written in SQL."""
