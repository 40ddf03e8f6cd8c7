"""Sparse multi-dimensional data on Spark: describe it, generate it, lay it out."""
