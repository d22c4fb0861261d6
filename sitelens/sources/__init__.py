"""Readers for seeds, leads, pages and ledgers, and the matching writers."""
