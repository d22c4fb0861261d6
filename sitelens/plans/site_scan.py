"""Site scans: crawl replay, page extraction, merge, contact summary, cap, shape."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitelens.functions import text
from sitelens.operators.context import join_context
from sitelens.operators.crawl import CrawlResult, crawl
from sitelens.operators.extract import is_list_field
from sitelens.operators.limits import limits_report, page_budget
from sitelens.operators.merge import contact_summary, merge_pages
from sitelens.operators.quality import field_coverage, quality_summary
from sitelens.operators.records import (
    cleanup_counters,
    count_warnings,
    in_output_order,
    output_columns,
    shape_records,
)
from sitelens.operators.skew import cut_lineage, salted_join
from sitelens.plans.result import Result
from sitelens.plans.spec import JobSpec, read_spec


def page_rows_of(scanned: CrawlResult, visits: DataFrame, spec: JobSpec) -> DataFrame:
    """One row per visit of a good page: lineage, provenance and processed fields."""
    good = visits.filter(F.col("error").isNull()).select(
        "target_idx", "seed", "visit_rank", F.col("url").alias("pop_url")
    )
    listed = {f.name: is_list_field(f) for f in spec.fields}
    empty = F.array().cast("array<string>")

    def provenance(name: str) -> Column:
        if name not in listed:
            return empty
        missing = text.is_empty(F.col(f"f_{name}"), listed[name])
        return F.when(missing, empty).otherwise(F.array("final_url"))

    lineage = {
        "page_url": F.col("final_url"),
        "status_code": F.col("status_code"),
        "source_urls": F.array("final_url"),
        "email_source_urls": provenance("emails"),
        "phone_source_urls": provenance("phones"),
    }
    # A field of the same name replaces a lineage column.
    columns = {**lineage, **{n: F.col(f"f_{n}") for n in listed}}
    joined = salted_join(
        good, scanned.archive.drop("links", "error"), ["pop_url"], known_rows=good.count()
    )
    return joined.select(
        F.col("target_idx").alias("__target"),
        F.col("seed").alias("__seed"),
        F.col("visit_rank").alias("__rank"),
        F.col("shred_error").alias("__error"),
        F.col("issues").alias("__issues"),
        F.col("final_url").alias("__url"),
        *[c.alias(n) for n, c in columns.items()],
    )


def site_scan(
    pages: DataFrame,
    seeds: DataFrame,
    spec: Mapping | JobSpec,
    contexts: DataFrame | None = None,
) -> Result:
    """Scan every seed over the page archive; one merged row per seed by default.

    ``pages``: requested_url, url, status_code, error, html. ``seeds``:
    target_idx and a normalized url. ``contexts``: input_url and input columns.
    """
    spec = read_spec(spec)
    seeds = cut_lineage(seeds.select("target_idx", "url"))
    scanned = crawl(pages, seeds, spec)
    visits = scanned.visits.join(seeds.withColumnRenamed("url", "seed"), "seed")
    page_rows = cut_lineage(page_rows_of(scanned, visits, spec))
    usable = page_rows.filter(F.col("__error").isNull())
    listed = {f.name: is_list_field(f) for f in spec.fields}
    names = list(listed)
    arrays = ["source_urls", "email_source_urls", "phone_source_urls"]
    if spec.merge_rows:
        fields = {**{n: True for n in arrays}, **listed}
        merged = merge_pages(usable, "__seed", "__rank", fields, spec.fields)
        owners = seeds.select(F.col("target_idx").alias("__target"), F.col("url").alias("__seed"))
        rows = merged.join(owners, "__seed").select(
            "__target", F.lit(1).alias("__rank"), F.col("__seed").alias("input_url"), *fields
        )
    else:
        own = [n for n in ["page_url", "status_code", *arrays] if n not in listed]
        rows = usable.select(
            "__target", "__rank", F.col("__seed").alias("input_url"), *own, *names
        )
    discovery = spec.metadata.get("contact_discovery", {})
    if isinstance(discovery, Mapping) and discovery.get("enabled"):
        rows = contact_summary(rows)
    rows = cut_lineage(rows)
    if spec.max_records is None:
        kept, budget = rows, None
    else:
        budget = cut_lineage(_budget(rows, seeds, spec))
        limited = rows.join(
            budget.select(F.col("target_idx").alias("__target"), "kept_records"), "__target"
        )
        # Rows of one target are at most crawl.max_pages.
        place = F.row_number().over(W.partitionBy("__target").orderBy("__rank"))
        kept = limited.withColumn("__n", place).filter("__n <= kept_records").drop(
            "__n", "kept_records"
        )
    ordered = kept.orderBy("__target", "__rank").drop("__target", "__rank")
    shaped = shape_records(ordered, spec.shaping)
    if contexts is not None:
        shaped = join_context(shaped, contexts)
    columns = output_columns(
        shaped.columns, spec.fields, shaping=spec.shaping, schema_columns=spec.schema_columns
    )
    shaped = in_output_order(shaped, columns)
    reached = visits
    if budget is not None:
        reached = visits.join(
            budget.filter("reached").select("target_idx"), "target_idx", "left_semi"
        )
    return Result(
        columns=columns,
        fields=names,
        mode=spec.mode,
        rows=shaped,
        visits=visits,
        targets=lambda: _target_report(reached, page_rows),
        issues=lambda: _issues(spec, reached, page_rows, budget),
        warnings=lambda: count_warnings(usable, "__issues"),
        cleanup=lambda: cleanup_counters(ordered, spec.shaping),
        coverage=lambda: field_coverage(shaped, names),
        summary=lambda: quality_summary(shaped, names),
        limits=lambda: limits_report(
            _budget(rows, seeds, spec) if budget is None else budget, spec.max_records
        ),
        frontier=lambda: scanned.frontier,
    )


def _budget(rows: DataFrame, seeds: DataFrame, spec: JobSpec) -> DataFrame:
    """Records per target against the record cap."""
    counts = rows.groupBy(F.col("__target").alias("target_idx")).agg(
        F.count(F.lit(1)).alias("n_records")
    )
    per_target = seeds.join(counts, "target_idx", "left").select(
        "target_idx", "url", F.coalesce("n_records", F.lit(0)).alias("n_records")
    )
    return page_budget(per_target, ["target_idx"], "n_records", spec.max_records)


def _target_report(visits: DataFrame, page_rows: DataFrame) -> DataFrame:
    broken = page_rows.filter(F.col("__error").isNotNull()).select(
        F.col("__seed").alias("seed"), F.col("__rank").alias("visit_rank"), F.lit(True).alias("broken")
    )
    marked = visits.join(broken, ["seed", "visit_rank"], "left")
    failed = F.col("error").isNotNull() | F.col("broken").isNotNull()
    return marked.groupBy("target_idx", F.col("seed").alias("target")).agg(
        F.count(F.lit(1)).alias("pages_crawled"),
        F.count_if(~failed).alias("pages_succeeded"),
        F.count_if(failed).alias("pages_failed"),
        F.count_if(F.col("error").isNotNull()).alias("error_count"),
    )


def _issues(
    spec: JobSpec, visits: DataFrame, page_rows: DataFrame, budget: DataFrame | None
) -> DataFrame:
    fetch = visits.filter(F.col("error").isNotNull()).select(
        F.lit("page_fetch_failed").alias("category"),
        F.concat_ws(": ", "final_url", "error").alias("message"),
    )
    parse = page_rows.filter(F.col("__error").isNotNull()).select(
        F.lit("page_extraction_failed").alias("category"),
        F.concat(F.col("__url"), F.lit(": extraction error: "), F.col("__error")).alias("message"),
    )
    if budget is None:
        return fetch.unionByName(parse)
    capped = budget.filter("cap_noticed").select(
        F.lit("max_records_reached").alias("category"),
        F.concat(
            F.lit(f"Record output was capped at {spec.max_records} during site_scan target "),
            F.col("url"),
            F.lit("."),
        ).alias("message"),
    )
    return fetch.unionByName(parse).unionByName(capped)
