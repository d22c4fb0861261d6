"""Field coverage, diagnostics and run counters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.functions import text
from sitelens.operators.records import is_list


def field_coverage(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Filled and empty counts and rates per configured field, one pass."""
    filled = {
        name: ~text.is_empty(F.col(name), is_list(rows, name)) if name in rows.columns else F.lit(False)
        for name in fields
    }
    totals = rows.agg(
        F.count(F.lit(1)).alias("__n"),
        *[F.count_if(test).alias(name) for name, test in filled.items()],
    )
    long = totals.unpivot(["__n"], list(filled), "field", "filled")
    n = F.col("__n")

    def rate(count) -> object:
        return F.when(n > 0, F.round(count / n, 3)).otherwise(F.lit(0.0))

    empty = n - F.col("filled")
    return long.select(
        "field",
        "filled",
        empty.alias("empty"),
        rate(F.col("filled")).alias("fill_rate"),
        rate(empty).alias("empty_rate"),
    )


def quality_summary(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Records, configured fields, all-empty records and output columns."""
    all_empty = F.lit(bool(fields))
    for name in fields:
        if name in rows.columns:
            all_empty = all_empty & text.is_empty(F.col(name), is_list(rows, name))
    return rows.agg(
        F.count(F.lit(1)).alias("records_produced"),
        F.lit(len(fields)).cast("bigint").alias("configured_field_count"),
        F.count_if(all_empty).alias("records_with_all_configured_fields_empty"),
        F.lit("; ".join(rows.columns)).alias("final_output_fields_seen"),
    )


def issue_counts(issues: DataFrame) -> DataFrame:
    """Number of issues per category."""
    return issues.groupBy("category").agg(F.count(F.lit(1)).alias("count"))


def top_messages(issues: DataFrame, limit: int = 10) -> DataFrame:
    """The most frequent messages, ties in message order."""
    return (
        issues.groupBy("message")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "message")
        .limit(limit)
    )


def stop_reason_counts(walks: DataFrame) -> DataFrame:
    return walks.groupBy("stop_reason").agg(F.count(F.lit(1)).alias("count"))


def run_totals(targets: DataFrame, counters: Sequence[str]) -> DataFrame:
    """Sum the per-target counters over a run."""
    return targets.agg(
        F.count(F.lit(1)).alias("target_count"),
        *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in counters],
    )
