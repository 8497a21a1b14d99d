"""Queries over the driver tables, and composed plans."""
