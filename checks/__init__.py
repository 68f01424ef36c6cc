"""Queries over the test tables, each with an independent SQL statement of its result."""
