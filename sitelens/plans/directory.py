"""Directory jobs: listing pages, listing plus detail pages, rendered directories."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import replace
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.functions import text
from sitelens.operators.css import compile_selector
from sitelens.operators.detail import cap_attempts, enrich, with_detail_url
from sitelens.operators.extract import Page, extract_fields, value_needs
from sitelens.operators.limits import limits_report, page_budget
from sitelens.operators.listing import (
    explode_records,
    listing_needs,
    listing_records,
    profile_records,
)
from sitelens.operators.paginate import Walk, next_page, next_page_needs, walk
from sitelens.operators.quality import field_coverage, quality_summary
from sitelens.operators.records import (
    cleanup_counters,
    count_warnings,
    in_output_order,
    output_columns,
    process_records,
    shape_records,
)
from sitelens.operators.skew import cut_lineage, salted_join, stored_by
from sitelens.plans.result import Result
from sitelens.plans.spec import JobSpec, read_spec

ORDER = ["target_idx", "page_idx", "rec_idx"]
BOOKKEEPING = ["detail_key", "detail_status", "detail_error", "detail_unread", "detail_page_url"]


def _profile_selector(rendered: Mapping | None) -> str | None:
    if rendered is None:
        return None
    selector = rendered.get("profile_link_selector")
    if not selector:
        raise ValueError("Rendered directories need playwright.profile_link_selector")
    return str(selector)


def _records(page: Page, spec: JobSpec, rendered: Mapping | None) -> Column:
    """Listing records of a page; profile links where a rendered page has none."""
    if rendered is None:
        return listing_records(page, spec.record_selector, spec.fields)
    linked = profile_records(page, _profile_selector(rendered), spec.detail_url_field)
    if not _uses_listing(spec, rendered):
        return linked
    many = {f.name for f in spec.fields if f.many}
    own = [f.name for f in spec.fields]
    names = list(dict.fromkeys([*own, spec.detail_url_field, "profile_url"]))

    def widen(entry: Column, have: list[str]) -> Column:
        def value(name: str) -> Column:
            kind = "array<string>" if name in many else "string"
            return entry[name] if name in have else F.lit(None).cast(kind)

        return F.struct(*[value(n).alias(n) for n in names])

    return text.let(
        F.transform(
            listing_records(page, spec.record_selector, spec.fields), lambda r: widen(r, own)
        ),
        lambda listed: F.when(F.size(listed) > 0, listed).otherwise(
            F.transform(linked, lambda r: widen(r, [spec.detail_url_field, "profile_url"]))
        ),
    )


def _uses_listing(spec: JobSpec, rendered: Mapping) -> bool:
    return bool(spec.record_selector) and not rendered.get("use_profile_urls_as_records", True)


def directory_archive(pages: DataFrame, spec: JobSpec, rendered: Mapping | None) -> DataFrame:
    """Everything a directory job wants to know of a page, from one parse.

    requested_url, url, error, next_raw, records, and the processed detail fields
    (``d_`` names, with ``d_issues``). The HTML is read once and never shuffled.
    """
    needs = next_page_needs(spec)
    if rendered is None or _uses_listing(spec, rendered):
        needs |= listing_needs(spec.record_selector, spec.fields)
    if rendered is not None:
        needs |= compile_selector(_profile_selector(rendered)).needs() | value_needs("href")

    def extra(page: Page) -> dict[str, Column]:
        found = F.when(F.col("error").isNull(), _records(page, spec, rendered))
        return {"next_raw": next_page(page, spec), "records": found}

    found = extract_fields(
        pages, spec.detail_fields, ["requested_url", "url", "error"],
        prefix="d_", also=needs, extra=extra,
    )
    return process_records(found, spec.detail_fields, spec.empty_like, "d_", "d_issues")


def _listing(pages: DataFrame, targets: DataFrame, spec: JobSpec, rendered: Mapping | None):
    """Archive, walk, page table with record budget, and the processed listing rows."""
    if rendered is not None:
        spec = replace(spec, pagination_enabled=False)  # one rendered page per target
    archive = stored_by(directory_archive(pages, spec, rendered), "requested_url", deal=True)
    # A page that could not be read to its end is a failed page, like one not fetched.
    unread = F.coalesce("error", "shred_error")
    walked: Walk = walk(archive.withColumn("error", unread), targets, spec)
    visits = walked.pages
    good = visits.filter(F.col("error").isNull())
    listed = cut_lineage(
        salted_join(
            good, archive.select("requested_url", "records"), ["requested_url"], known_rows=good.count()
        ).withColumn("n_records", F.coalesce(F.size("records"), F.lit(0)))
    )
    budget = cut_lineage(
        page_budget(
            listed.drop("records"), ["target_idx", "page_idx"], "n_records", spec.max_records
        )
    )
    if spec.max_records is None:
        kept = listed
    else:
        kept = (
            listed.join(
                budget.select("target_idx", "page_idx", "kept_records"), ["target_idx", "page_idx"]
            )
            .filter(F.col("kept_records") > 0)
            .withColumn("records", F.slice("records", F.lit(1), F.col("kept_records").cast("int")))
        )
    # Named apart from the record fields, which may be called the same.
    renamed = {"target": "__input", "url": "__page"}
    rows = explode_records(
        kept.withColumnsRenamed(renamed), ["target_idx", "__input", "page_idx", "__page"]
    )
    rows = process_records(rows, spec.fields, spec.empty_like, issues="__issues")
    return archive, walked, visits, budget, rows


def _cut_point(budget: DataFrame) -> DataFrame:
    """The page on which the record cap was noticed, as at most one row."""
    return budget.filter("cap_noticed").agg(
        F.min(F.struct("target_idx", "page_idx")).alias("cut"), F.lit(1).alias("__all")
    )


def _processed(visits: DataFrame, budget: DataFrame) -> DataFrame:
    """Visits the job got to before the record cap stopped it."""
    at = F.struct("target_idx", "page_idx")
    return (
        visits.withColumn("__all", F.lit(1))
        .join(F.broadcast(_cut_point(budget)), "__all")
        .withColumns(
            {
                "page_processed": F.col("cut").isNull() | (at <= F.col("cut")),
                "target_processed": F.col("cut").isNull()
                | (F.col("target_idx") <= F.col("cut.target_idx")),
            }
        )
        .drop("cut", "__all")
    )


def _target_report(walked: Walk, pages: DataFrame, budget: DataFrame, details: DataFrame | None):
    failed = F.col("error").isNotNull()
    per_target = pages.filter("target_processed").groupBy("target_idx", "target").agg(
        F.count(F.lit(1)).alias("pages_visited"),
        F.count_if(~failed).alias("pages_succeeded"),
        F.count_if(failed).alias("pages_failed"),
    )
    listings = budget.groupBy("target_idx").agg(F.sum("kept_records").alias("listing_count"))
    report = per_target.join(listings, "target_idx", "left").join(
        walked.targets.select(
            "target_idx",
            "stop_reason",
            F.size("urls_followed").cast("bigint").alias("pagination_urls_followed"),
        ),
        "target_idx",
    )
    counters = ["detail_pages_attempted", "detail_pages_successful", "detail_pages_failed"]
    if details is not None:
        done = details.groupBy("target_idx").agg(
            F.count_if(F.col("detail_status").isin("success", "failed")).alias(counters[0]),
            F.count_if(F.col("detail_status") == "success").alias(counters[1]),
            F.count_if(F.col("detail_status") == "failed").alias(counters[2]),
        )
        report = report.join(done, "target_idx", "left")
    zero = F.lit(0).cast("bigint")
    value = {c: F.coalesce(c, zero) if details is not None else zero for c in counters}
    return report.select(
        "target_idx",
        "target",
        (F.col("pages_visited") + value[counters[0]]).alias("pages_crawled"),
        "pages_visited",
        (F.col("pages_succeeded") + value[counters[1]]).alias("pages_succeeded"),
        (F.col("pages_failed") + value[counters[2]]).alias("pages_failed"),
        F.coalesce("listing_count", zero).alias("listing_count"),
        *[value[c].alias(c) for c in counters],
        "pagination_urls_followed",
        "stop_reason",
    )


def _issues(
    spec: JobSpec, pages: DataFrame, budget: DataFrame, walked: Walk, details: DataFrame | None,
    rendered: Mapping | None,
) -> DataFrame:
    page_category = "playwright_directory_render_failed" if rendered is not None else "directory_page_fetch_failed"
    context = {"directory_list": "directory_list page ", "directory_detail": "directory_detail page "}
    where = F.concat(F.lit(context.get(spec.mode, "")), F.col("url"))
    if rendered is not None:
        where = F.concat(F.lit("playwright directory_detail target "), F.col("target"))
    found = pages.filter(F.col("page_processed") & F.col("error").isNotNull()).select(
        F.lit(page_category).alias("category"),
        F.concat_ws(": ", "target" if rendered is not None else "url", "error").alias("message"),
    )
    found = found.unionByName(
        budget.filter("cap_noticed").select(
            F.lit("max_records_reached").alias("category"),
            F.concat(
                F.lit(f"Record output was capped at {spec.max_records} during "), where, F.lit(".")
            ).alias("message"),
        )
    )
    found = found.unionByName(
        walked.targets.select(
            F.lit("invalid_next_page_url").alias("category"), F.explode("errors").alias("message")
        )
    )
    if details is None:
        return found
    skipped = F.col("detail_status") == "skipped"
    found = found.unionByName(
        details.filter(F.col("detail_status") == "failed").select(
            F.when(F.col("detail_unread"), F.lit("detail_field_extraction_failed"))
            .otherwise(F.lit("detail_page_fetch_failed"))
            .alias("category"),
            F.concat_ws(": ", "detail_page_url", "detail_error").alias("message"),
        )
    ).unionByName(
        details.filter(skipped).select(
            F.lit("detail_page_limit_skipped").alias("category"),
            F.lit("Detail page fetch skipped because max_detail_pages was reached.").alias("message"),
        )
    )
    hit = details.agg(F.coalesce(F.bool_or(skipped), F.lit(False)).alias("hit")).filter("hit")
    return found.unionByName(
        hit.select(
            F.lit("max_detail_pages_reached").alias("category"),
            F.lit(f"Detail page enrichment was capped at {spec.max_detail_pages}.").alias("message"),
        )
    )


def _finish(spec, walked, visits, budget, rows, issue_columns, names, details, rendered) -> Result:
    ordered = rows.orderBy(*ORDER).drop(*ORDER, *issue_columns, *BOOKKEEPING)
    shaped = shape_records(ordered, spec.shaping)
    columns = output_columns(
        shaped.columns, spec.fields, spec.detail_fields, spec.shaping, spec.schema_columns
    )
    shaped = in_output_order(shaped, columns)

    @cache
    def pages() -> DataFrame:
        return cut_lineage(_processed(visits, budget))

    return Result(
        columns=columns,
        fields=names,
        mode=spec.mode,
        rows=shaped,
        visits=visits,
        targets=lambda: _target_report(walked, pages(), budget, details),
        issues=lambda: _issues(spec, pages(), budget, walked, details, rendered),
        warnings=lambda: count_warnings(rows, *issue_columns),
        cleanup=lambda: cleanup_counters(ordered, spec.shaping),
        coverage=lambda: field_coverage(shaped, names),
        summary=lambda: quality_summary(shaped, names),
        limits=lambda: limits_report(budget, spec.max_records, spec.max_detail_pages, details),
    )


def directory_list(pages: DataFrame, targets: DataFrame, spec: Mapping | JobSpec) -> Result:
    """Walk the listing pages of every target and return their records.

    ``pages``: requested_url, url, status_code, error, html. ``targets``:
    target_idx and a normalized target.
    """
    spec = read_spec(spec)
    _, walked, visits, budget, rows = _listing(pages, targets, spec, None)
    names = [f.name for f in spec.fields]
    lineage = {
        "input_url": F.col("__input"), "source_url": F.col("__page"), "page_url": F.col("__page"),
    }
    own = [c.alias(n) for n, c in lineage.items() if n not in names]
    rows = cut_lineage(rows.select(*ORDER, *own, *names, "__issues"))
    return _finish(spec, walked, visits, budget, rows, ["__issues"], names, None, None)


def _render_settings(spec: JobSpec) -> Mapping | None:
    if str(spec.metadata.get("renderer", "")).strip().lower() != "playwright":
        return None
    private = str(spec.metadata.get("audience", "")).strip().lower() == "private"
    if not private and not spec.metadata.get("private_only"):
        raise ValueError("Rendered directories need metadata.audience=private or private_only")
    settings = spec.metadata.get("playwright")
    if not isinstance(settings, Mapping):
        raise ValueError("Rendered directories need a metadata.playwright block")
    return settings


def directory_detail(pages: DataFrame, targets: DataFrame, spec: Mapping | JobSpec) -> Result:
    """Listing records enriched from the detail page each of them points to.

    With ``metadata.renderer = "playwright"`` the pages are archived renderings:
    one page per target, whose profile links can stand in for listing records.
    """
    spec = read_spec(spec)
    rendered = _render_settings(spec)
    archive, walked, visits, budget, rows = _listing(pages, targets, spec, rendered)
    listed = [c for c in rows.columns if c not in ("__input", "__page", "__issues", *ORDER)]
    lineage = {"input_url": F.col("__input"), "source_url": F.col("__page")}
    if rendered is not None:
        lineage["source_directory"] = F.col("__page")
    lineage["page_url"] = F.col("__page")
    own = [c.alias(n) for n, c in lineage.items() if n not in listed]
    rows = rows.select(*ORDER, *own, *listed, "__issues", "__page")
    rows = with_detail_url(rows, spec.detail_url_field)
    if rendered is not None:
        given = F.col("profile_url") if "profile_url" in rows.columns else F.lit(None).cast("string")
        rows = rows.withColumn(
            "profile_url", F.when(text.blank(given), F.col("detail_key")).otherwise(given)
        )
    rows = cut_lineage(cap_attempts(rows, ORDER, spec.max_detail_pages))
    details = archive.drop("next_raw", "records").withColumnsRenamed(
        {"requested_url": "detail_key", "url": "d_url", "error": "d_error", "shred_error": "d_shred_error"}
    )
    enriched = enrich(rows, details, spec.detail_fields, known_rows=rows.count())
    if rendered is not None:
        good = F.col("detail_status") == "success"
        enriched = enriched.withColumns(
            {
                "profile_url": F.when(good, F.col("detail_url")).otherwise(F.col("profile_url")),
                "source_directory": F.when(good, F.col("__page")).otherwise(F.col("source_directory")),
            }
        )
    enriched = cut_lineage(enriched.drop("__page"))
    names = [f.name for f in spec.fields] + [f.name for f in spec.detail_fields]
    if rendered is not None:
        names += ["profile_url", "source_directory"]
    return _finish(
        spec, walked, visits, budget, enriched, ["__issues", "detail_issues"],
        list(dict.fromkeys(names)), enriched, rendered,
    )
