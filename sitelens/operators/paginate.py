"""Pagination walks: all targets follow their next-page links round by round."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.functions import urls
from sitelens.functions.text import first_item
from sitelens.operators.crawl import MISSING_PAGE
from sitelens.operators.css import compile_selector
from sitelens.operators.extract import Page, css_values, extract_fields, value_needs
from sitelens.operators.shred import NodeNeeds
from sitelens.operators.skew import cut_lineage, salted_join
from sitelens.plans.spec import JobSpec


@dataclass
class Walk:
    pages: DataFrame  # target_idx, target, page_idx, requested_url, url, error
    targets: DataFrame  # target_idx, target, stop_reason, pages_visited, urls_followed, errors


def next_page(page: Page, spec: JobSpec) -> Column:
    """The raw next-page URL of a page, made absolute."""
    if not (spec.pagination_enabled and spec.next_page_css):
        return F.lit(None).cast("string")
    selector = compile_selector(spec.next_page_css)
    return first_item(css_values(page, selector, spec.next_page_attribute, page.url))


def next_page_needs(spec: JobSpec) -> NodeNeeds:
    if not (spec.pagination_enabled and spec.next_page_css):
        return NodeNeeds()
    return compile_selector(spec.next_page_css).needs() | value_needs(spec.next_page_attribute)


def next_page_links(pages: DataFrame, spec: JobSpec) -> DataFrame:
    """requested_url, url, error and next_raw of every archived page."""
    return extract_fields(
        pages,
        [],
        ["requested_url", "url", "error"],
        also=next_page_needs(spec),
        extra=lambda page: {"next_raw": next_page(page, spec)},
    )


def walk(links: DataFrame, targets: DataFrame, spec: JobSpec) -> Walk:
    """Follow next-page links from every target, at most ``max_pages`` rounds.

    ``links`` is what ``next_page_links`` returns, stored. ``targets`` has
    ``target_idx`` and a normalized ``target``. The state is one row per target
    with the pages it has seen, at most ``max_pages`` of them.
    """
    archive = links.select(
        "requested_url", F.lit(True).alias("found"), F.col("url").alias("final_url"), "error", "next_raw"
    )
    limit = max(1, spec.pagination_max_pages if spec.pagination_enabled else 1)
    seen_type = "array<struct<page_idx:int,requested_url:string,url:string,error:string>>"
    state = cut_lineage(
        targets.select(
            "target_idx",
            "target",
            F.col("target").alias("requested_url"),
            F.array().cast(seen_type).alias("seen"),
            F.array().cast("array<string>").alias("errors"),
            F.lit(None).cast("string").alias("stop_reason"),
        )
    )
    done = None
    for page_idx in range(limit):
        active = state.count()
        if active == 0:
            break
        step = salted_join(state, archive, ["requested_url"], "left", known_rows=active)
        error = F.when(F.col("found").isNull(), F.lit(MISSING_PAGE)).otherwise(F.col("error"))
        visit = F.struct(
            F.lit(page_idx).alias("page_idx"),
            F.col("requested_url"),
            F.coalesce("final_url", "requested_url").alias("url"),
            error.alias("error"),
        )
        step = step.withColumns(
            {
                "seen": F.array_append("seen", visit).cast(seen_type),
                "failed": error.isNotNull(),
                "following": urls.normalize_url("next_raw"),
            }
        )
        visited = F.exists("seen", lambda p: p.requested_url == F.col("following"))
        reason = F.when(F.col("failed"), "fetch_failure")
        if not spec.pagination_enabled:
            reason = reason.otherwise("pagination_disabled")
        elif page_idx + 1 >= limit:
            reason = reason.otherwise("max_pages_reached")
        else:
            reason = (
                reason.when(F.col("next_raw").isNull() | (F.col("next_raw") == ""), "no_next_page_found")
                .when(F.col("following").isNull(), "invalid_next_page_url")
                .when(visited, "duplicate_next_page_detected")
            )
        step = step.withColumn("stop_reason", reason).withColumn(
            "errors",
            F.when(
                F.col("stop_reason") == "invalid_next_page_url",
                F.array_append(
                    "errors",
                    F.concat(F.coalesce("final_url", "requested_url"), F.lit(": invalid next page url")),
                ),
            ).otherwise(F.col("errors")),
        )
        state = cut_lineage(
            step.select(
                "target_idx",
                "target",
                F.when(F.col("stop_reason").isNull(), F.col("following"))
                .otherwise(F.col("requested_url")).alias("requested_url"),
                "seen",
                "errors",
                "stop_reason",
            )
        )
        finished = state.filter(F.col("stop_reason").isNotNull())
        done = finished if done is None else done.unionByName(finished)
        state = state.filter(F.col("stop_reason").isNull())
    visits = done.select("target_idx", "target", F.inline("seen"))
    return Walk(
        visits,
        done.select(
            "target_idx",
            "target",
            "stop_reason",
            F.size("seen").alias("pages_visited"),
            F.transform(
                F.slice("seen", F.lit(2), F.greatest(F.size("seen") - 1, F.lit(0))),
                lambda p: p.requested_url,
            ).alias("urls_followed"),
            "errors",
        ),
    )
