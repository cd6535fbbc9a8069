"""Queries over the stand-in tables, one module for each family; each with the DuckDB statement that gives the same rows."""
