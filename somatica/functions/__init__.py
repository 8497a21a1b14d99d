"""Scalar expressions: cell metrics, names, numbers."""
