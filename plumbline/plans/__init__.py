"""Queries over the demo tables, with their SQL."""
