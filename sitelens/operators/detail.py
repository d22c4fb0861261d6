"""Detail enrichment: listing rows joined with the detail pages they point to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.functions import text, urls
from sitelens.operators.crawl import MISSING_PAGE
from sitelens.operators.extract import is_list_field
from sitelens.operators.limits import running_total
from sitelens.operators.records import is_list
from sitelens.operators.skew import salted_join
from sitelens.plans.spec import FieldSpec


def with_detail_url(rows: DataFrame, url_field: str) -> DataFrame:
    """Add ``detail_key``: the normalized detail URL of a row, or null."""
    if url_field not in rows.columns:
        return rows.withColumn("detail_key", F.lit(None).cast("string"))
    raw = F.col(url_field)
    if is_list(rows, url_field):
        raw = text.first_item(raw)
    return rows.withColumn("detail_key", urls.normalize_url(raw))


def cap_attempts(
    rows: DataFrame, order: Sequence[str], max_detail_pages: int | None
) -> DataFrame:
    """Add ``detail_status``: none, attempt or skipped, counting rows in order."""
    wanted = F.col("detail_key").isNotNull()
    if max_detail_pages is None:
        return rows.withColumn(
            "detail_status", F.when(wanted, F.lit("attempt")).otherwise(F.lit("none"))
        )
    counted = running_total(rows, order, wanted.cast("int"), "__attempts")
    return counted.withColumn(
        "detail_status",
        F.when(~wanted, F.lit("none"))
        .when(F.col("__attempts") < max_detail_pages, F.lit("attempt"))
        .otherwise(F.lit("skipped")),
    ).drop("__attempts")


def enrich(
    rows: DataFrame,
    details: DataFrame,
    fields: Sequence[FieldSpec],
    known_rows: int | None = None,
) -> DataFrame:
    """Let non-empty detail values override base values where the page is good.

    ``details`` has detail_key, d_url, d_error, d_shred_error, d_issues and one
    ``d_`` column per field. Adds ``detail_url``, ``detail_error``, ``detail_unread``
    (found, but not read to its end), ``detail_issues`` and the final status. Many rows
    may point to one detail page, so the rows are the salted side.
    """
    base = rows.withColumn(
        "__join", F.when(F.col("detail_status") == "attempt", F.col("detail_key"))
    ).withColumn("__join", F.coalesce("__join", F.concat(F.lit("\x00"), F.xxhash64(*rows.columns).cast("string"))))
    lookup = details.withColumnRenamed("detail_key", "__join").withColumn("d_found", F.lit(True))
    joined = salted_join(base, lookup, ["__join"], "left", known_rows=known_rows)
    attempted = F.col("detail_status") == "attempt"
    failure = F.when(F.col("d_found").isNull(), F.lit(MISSING_PAGE)).otherwise(
        F.coalesce("d_error", "d_shred_error")
    )
    good = attempted & failure.isNull()
    columns: dict[str, Column] = {}
    for name in rows.columns:
        columns[name] = F.col(name)
    for field in fields:
        listed = is_list_field(field)
        value = F.col(f"d_{field.name}")
        if field.name in rows.columns:
            present = F.col(field.name)
            base_listed = is_list(rows, field.name)
            if listed and not base_listed:
                present, base_listed = F.array(present), True
            elif base_listed and not listed:
                value, listed = F.array(value), True
        else:
            present = F.lit(None).cast("array<string>" if listed else "string")
        columns[field.name] = F.when(
            F.coalesce(good, F.lit(False)) & ~text.is_empty(value, listed), value
        ).otherwise(present)
    own = F.col("detail_url") if "detail_url" in rows.columns else F.lit(None).cast("string")
    columns["detail_url"] = F.when(good, F.col("d_url")).otherwise(own)
    columns["detail_error"] = F.when(attempted, failure)
    columns["detail_unread"] = attempted & F.col("d_error").isNull() & F.col("d_shred_error").isNotNull()
    columns["detail_status"] = F.when(
        attempted, F.when(failure.isNull(), F.lit("success")).otherwise(F.lit("failed"))
    ).otherwise(F.col("detail_status"))
    columns["detail_issues"] = F.when(good, F.col("d_issues"))
    columns["detail_page_url"] = F.when(attempted, F.coalesce("d_url", "detail_key"))
    return joined.select(*[c.alias(n) for n, c in columns.items()])
