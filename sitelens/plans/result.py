"""What a job returns: its rows and its report tables, all DataFrames.

Report tables are planned when they are first asked for, so a caller that only
wants the rows does not pay for the rest.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame

TABLES = [
    "rows",  # the output records
    "visits",  # pages in the order they were visited
    "frontier",  # URLs still queued when a crawl ended
    "targets",  # counters per target
    "issues",  # category, message
    "warnings",  # transforms that could not be applied
    "cleanup",  # cleanup counters
    "coverage",  # filled and empty values per field
    "summary",  # totals over the output records
    "limits",  # limits and what they cost
    "stats",  # lead cleaning counters
]


class Result:
    """``result.rows``, ``result.targets`` and so on; None for tables a job lacks."""

    def __init__(
        self,
        columns: Sequence[str] = (),
        fields: Sequence[str] = (),
        mode: str | None = None,
        **tables: DataFrame | Callable[[], DataFrame],
    ) -> None:
        unknown = set(tables) - set(TABLES)
        if unknown:
            raise TypeError(f"Unknown result tables: {sorted(unknown)}")
        self._tables = tables
        self.columns = list(columns)  # output columns in order, also those that no row has
        self.fields = list(fields)  # configured fields
        self.mode = mode

    def __getattr__(self, name: str) -> DataFrame | None:
        if name not in TABLES:
            raise AttributeError(name)
        table = self._tables.get(name)
        if callable(table) and not isinstance(table, DataFrame):
            table = self._tables[name] = table()
        return table
