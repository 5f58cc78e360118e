"""Queries over the test tables, each with the SQL of the same result."""
