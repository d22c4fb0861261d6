"""Registered queries and the SQL each one is checked against."""

from __future__ import annotations

from importlib import import_module

_MODULES = ["page_queries", "record_queries", "lead_queries", "walk_queries", "job_queries", "output_queries"]


def _collect(attribute: str) -> dict:
    found: dict = {}
    for name in _MODULES:
        found.update(getattr(import_module(f"sitelens.catalog.{name}"), attribute))
    return found


def queries() -> dict:
    return _collect("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _collect("ORACLE")
