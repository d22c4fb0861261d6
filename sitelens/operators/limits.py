"""Record and detail-page caps over ordered pages and records.

Both caps are global, so they need running totals. A total over all rows in one
task would not scale; totals are built in two levels instead: rows are split into
balanced ranges of the order, one small table holds a total per range, and windows
only run inside a range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitelens.operators.skew import cut_lineage


def running_total(
    df: DataFrame, order: Sequence[str], value: Column, name: str, ranges: int | None = None
) -> DataFrame:
    """Add ``name``: the sum of ``value`` over all rows before this one.

    Ranges follow all order columns, so neither uneven numbers nor a target with
    very many rows makes a range large. The split is checkpointed: a range must
    mean the same rows in both uses below.
    """
    split = [ranges] if ranges else []
    ranged = cut_lineage(
        df.withColumn("__v", value.cast("bigint"))
        .repartitionByRange(*split, *order)
        .withColumn("__range", F.spark_partition_id())
    )
    # At most one row per shuffle partition, so this window and the broadcast are small.
    totals = ranged.groupBy("__range").agg(F.sum("__v").alias("__t"))
    earlier = W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    before = totals.select(
        "__range", F.coalesce(F.sum("__t").over(earlier), F.lit(0)).alias("__before")
    )
    inside = W.partitionBy("__range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return (
        ranged.withColumn("__inside", F.coalesce(F.sum("__v").over(inside), F.lit(0)))
        .join(F.broadcast(before), "__range")
        .withColumn(name, F.col("__before") + F.col("__inside"))
        .drop("__v", "__range", "__inside", "__before")
    )


def page_budget(
    pages: DataFrame, order: Sequence[str], records: str, max_records: int | None,
    ranges: int | None = None,
) -> DataFrame:
    """Per page: records kept and cut, and whether the walk still reached it.

    ``pages`` has one row per page with its record count. The page on which the
    cap is noticed is the last one processed; a cap met exactly is noticed on the
    next page, even an empty one.
    """
    n = F.col(records).cast("bigint")
    if max_records is None:
        return pages.withColumns(
            {
                "reached": F.lit(True),
                "kept_records": n,
                "cut_records": F.lit(0).cast("bigint"),
                "cap_noticed": F.lit(False),
            }
        )
    seen = F.col("__seen")
    counted = running_total(pages, order, n, "__seen", ranges).withColumn(
        "__noticed", (seen >= max_records) | (seen + n > max_records)
    )
    at = F.struct(*order)
    first = counted.agg(
        F.min(F.when(F.col("__noticed"), at)).alias("__cut"), F.lit(1).alias("__all")
    )
    marked = counted.withColumn("__all", F.lit(1)).join(F.broadcast(first), "__all")
    reached = F.col("__cut").isNull() | (at <= F.col("__cut"))
    kept = F.least(n, F.greatest(F.lit(max_records) - seen, F.lit(0)))
    return marked.select(
        *pages.columns,
        reached.alias("reached"),
        F.when(reached, kept).otherwise(0).cast("bigint").alias("kept_records"),
        F.when(reached, n - kept).otherwise(0).cast("bigint").alias("cut_records"),
        (reached & F.col("__noticed")).alias("cap_noticed"),
    )


def limits_report(
    pages: DataFrame, max_records: int | None, max_detail_pages: int | None = None,
    attempts: DataFrame | None = None,
) -> DataFrame:
    """One row: the limits, whether each was hit and what it cost."""
    report = pages.agg(
        F.lit(max_records).cast("bigint").alias("max_records"),
        F.lit(max_detail_pages).cast("bigint").alias("max_detail_pages"),
        F.coalesce(F.bool_or("cap_noticed"), F.lit(False)).alias("max_records_hit"),
        F.coalesce(F.sum("cut_records"), F.lit(0)).alias("records_truncated"),
    )
    if attempts is None:
        skipped = F.lit(0).cast("bigint")
        return report.withColumn("max_detail_pages_hit", F.lit(False)).withColumn(
            "detail_pages_skipped_due_to_limit", skipped
        )
    skipped = attempts.agg(
        F.coalesce(F.sum((F.col("detail_status") == "skipped").cast("bigint")), F.lit(0)).alias(
            "detail_pages_skipped_due_to_limit"
        ),
        F.lit(1).alias("__one"),
    )
    return (
        report.withColumn("__one", F.lit(1))
        .join(skipped, "__one")
        .drop("__one")
        .withColumn("max_detail_pages_hit", F.col("detail_pages_skipped_due_to_limit") > 0)
    )
