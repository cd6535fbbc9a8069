"""Whole jobs, from sources to results."""
