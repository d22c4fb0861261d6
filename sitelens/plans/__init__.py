"""Composite jobs assembled from the operators."""
