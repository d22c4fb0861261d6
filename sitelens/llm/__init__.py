"""Operators for cleaning large text corpora before training."""
