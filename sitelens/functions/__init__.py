"""Scalar Column functions: text, URLs, contact heuristics, transforms."""
