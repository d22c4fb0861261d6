"""Cleaning jobs: module pipelines over a CSV table, and lead cleaning."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from sitelens.operators import leads
from sitelens.operators.modules import run_modules
from sitelens.operators.quality import field_coverage, quality_summary
from sitelens.plans.result import Result


def clean_csv(df: DataFrame, steps: Sequence[Mapping]) -> tuple[Result, list]:
    """Run the modules; the observations hold row counts once rows were produced."""
    rows, observed = run_modules(df, steps)
    names = rows.columns
    return Result(
        columns=names,
        fields=names,
        mode="clean_csv",
        rows=rows,
        coverage=lambda: field_coverage(rows, names),
        summary=lambda: quality_summary(rows, names),
    ), observed


def clean_leads(rows: DataFrame, settings: Mapping | None = None, idx: str | None = None) -> Result:
    cleaned = leads.clean_leads(rows, settings, idx)
    return Result(rows=cleaned.rows, stats=cleaned.stats)
