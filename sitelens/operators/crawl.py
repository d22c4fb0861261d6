"""Best-first site scans replayed over a page archive.

One DataFrame round pops one URL for every seed at once. Links are rows: each round writes
those it has found to a table bucketed by (seed, URL), after an anti join with the tables of
the rounds before, so neither a hub page nor a large site makes a large row. A seed itself
is one short row: its visits, and of its queue the best URLs, no more than it may still
visit; the others can only end up in the frontier. The archive is a table bucketed by
requested URL, the seeds are one bucketed by seed: per round (seed, popped URL) moves to the
pages and the links of the popped pages move to their (seed, URL); no table moves again.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitelens.functions import urls
from sitelens.operators.extract import LINK_NEEDS, Page, extract_fields
from sitelens.operators.limits import running_total
from sitelens.operators.links import rank_links
from sitelens.operators.records import process_records
from sitelens.operators.skew import drop_stored, salted_join, stored_by
from sitelens.plans.spec import JobSpec

SEED_SCORE = 10_000
MISSING_PAGE = "Page is not in the archive"
# Tables of links before they are written together as one.
MAX_TABLES = 8

_QUEUED = "struct<minus:int,seq:bigint,url:string,depth:int>"
_VISITS = "array<struct<rank:int,url:string,final_url:string,depth:int,status_code:int,error:string>>"
_FOUND = (
    "array<struct<is_link:boolean,url:string,minus:int,seq:bigint,depth:int,"
    "popped:string,status_code:int,error:string>>"
)


class CrawlResult:
    """``visits`` (seed, visit_rank, url, final_url, depth, status_code, error), ``archive``
    (what link_archive returns) and, worked out when asked for, ``frontier``."""

    def __init__(self, visits: DataFrame, archive: DataFrame, queued: DataFrame) -> None:
        self.visits, self.archive, self._queued = visits, archive, queued

    @cached_property
    def frontier(self) -> DataFrame:
        """seed, queue_rank, url, score, depth of what was queued and not visited."""
        visited = self.visits.select("seed", "url")
        left = self._queued.join(visited, ["seed", "url"], "left_anti")
        # Ranks come from running totals, as one seed may own most of the rows.
        placed = running_total(left, ["seed", "minus", "seq"], F.lit(1), "queued_before")
        first = placed.groupBy("seed").agg(F.min("queued_before").alias("first_before"))
        return salted_join(placed, first, ["seed"]).select(
            "seed",
            (F.col("queued_before") - F.col("first_before") + 1).cast("int").alias("queue_rank"),
            "url",
            (-F.col("minus")).alias("score"),
            "depth",
        )


def link_archive(pages: DataFrame, spec: JobSpec) -> DataFrame:
    """Per requested URL: final URL, status, error, ranked links and page fields.

    ``pages`` holds requested_url, url, status_code, error and html, one row per
    requested URL. Links and the fields of the spec (``f_`` names, with ``issues``)
    come from the same parse, so the HTML is read once and never shuffled.
    """

    def links(page: Page) -> dict[str, Column]:
        ranked = rank_links(
            page.links, spec.priority_keywords, spec.include_url_keywords, spec.exclude_url_keywords
        )
        followed = F.transform(
            ranked,
            lambda k: F.struct(
                k.url.alias("url"),
                k.score.alias("score"),
                urls.canonical_domain(k.url).alias("domain"),
            ),
        )
        return {"links": F.when(F.col("error").isNull(), followed)}

    found = extract_fields(
        pages,
        spec.fields,
        ["requested_url", "url", "status_code", "error"],
        prefix="f_",
        also=LINK_NEEDS,
        extra=links,
    )
    renamed = found.withColumnsRenamed({"requested_url": "pop_url", "url": "final_url"})
    return process_records(renamed, spec.fields, spec.empty_like, "f_", "issues")


def crawl_round(
    state: DataFrame,
    archive: DataFrame,
    known: Sequence[DataFrame],
    round_no: int,
    same_domain_only: bool,
    known_rows: int,
) -> DataFrame:
    """What the best URL of every seed leads to: a row for the visit and one for each link
    (``is_link``) that the seed has neither queued nor visited."""
    best = F.get("heads", 0)
    pops = state.filter(F.size("heads") > 0).select(
        "seed",
        "seed_domain",
        best.url.alias("pop_url"),
        best.depth.alias("depth"),
        F.transform("visits", lambda v: v.final_url).alias("finals"),
    )
    pages = archive.select("pop_url", "final_url", "status_code", "error", "links", F.lit(True).alias("found"))
    reached = salted_join(pops, pages, ["pop_url"], "left", known_rows=known_rows)
    final_url = F.coalesce("final_url", "pop_url")
    none = F.lit(None)
    visit = F.struct(
        F.lit(False).alias("is_link"),
        final_url.alias("url"),
        none.alias("minus"),
        none.alias("seq"),
        F.col("depth"),
        F.col("pop_url").alias("popped"),
        F.col("status_code"),
        F.when(F.col("found").isNull(), F.lit(MISSING_PAGE)).otherwise(F.col("error")).alias("error"),
    )
    links = F.coalesce("links", F.array().cast("array<struct<url:string,score:int,domain:string>>"))
    own = F.col("seed_domain")
    unseen = F.filter(
        links,
        lambda k: ((k.domain == own) if same_domain_only else F.lit(True))
        & (k.url != final_url) & (k.url != F.col("seed")) & ~F.array_contains("finals", k.url),
    )
    listed = F.transform(
        unseen,
        lambda k, i: F.struct(
            F.lit(True).alias("is_link"),
            k.url.alias("url"),
            (-k.score).alias("minus"),
            (F.lit(round_no).cast("bigint") * F.lit(1 << 32) + i).alias("seq"),
            (F.col("depth") + 1).alias("depth"),
            none.alias("popped"),
            none.alias("status_code"),
            none.alias("error"),
        ).cast(_FOUND[len("array<") : -1]),
    )
    each = F.explode(F.concat(F.array(visit).cast(_FOUND), listed.cast(_FOUND)))
    rows = reached.select("seed", each.alias("__r")).select("seed", "__r.*")
    for queued in known:
        earlier = queued.filter("is_link").select(F.col("seed").alias("__seed"), F.col("url").alias("__url"))
        again = F.col("is_link") & (F.col("seed") == F.col("__seed")) & (F.col("url") == F.col("__url"))
        rows = rows.join(earlier, again, "left_anti")
    return rows


def _advance(state: DataFrame, rows: DataFrame, round_no: int, still: int) -> DataFrame:
    """The seeds after a round; of their queues the ``still`` best URLs are kept."""
    visit = F.struct(
        F.lit(round_no).alias("rank"),
        F.col("popped").alias("url"),
        F.col("url").alias("final_url"),
        F.col("depth"),
        F.col("status_code"),
        F.col("error"),
    )
    visits = rows.filter("not is_link").select("seed", visit.alias("__visit"))
    joined = state.join(visits, "seed", "left")
    nothing = F.array().cast(f"array<{_QUEUED}>")
    heads = nothing
    if still:
        # A window limit: each task hands on no more than that many rows of a seed.
        place = F.row_number().over(W.partitionBy("seed").orderBy("minus", "seq"))
        fresh = rows.filter("is_link").withColumn("__n", place).filter(F.col("__n") <= still)
        entry = F.struct("minus", "seq", "url", "depth")
        joined = joined.join(fresh.groupBy("seed").agg(F.collect_list(entry).alias("__fresh")), "seed", "left")
        others = F.slice("heads", 2, F.greatest(F.size("heads") - 1, F.lit(0)))
        heads = F.slice(F.array_sort(F.concat(others, F.coalesce("__fresh", nothing))), 1, still)
    return joined.select(
        "seed",
        "seed_domain",
        heads.cast(f"array<{_QUEUED}>").alias("heads"),
        F.when(F.col("__visit").isNotNull(), F.array_append("visits", F.col("__visit")))
        .otherwise(F.col("visits")).cast(_VISITS).alias("visits"),
    )


def crawl(pages: DataFrame, seeds: DataFrame, spec: JobSpec) -> CrawlResult:
    """Replay the best-first scan of every seed over the archive.

    ``seeds`` has one normalized ``url`` per row. Pages missing from the archive
    count as error pages.
    """
    archive = stored_by(link_archive(pages, spec), "pop_url", deal=True)
    start = F.struct(
        F.lit(-SEED_SCORE).alias("minus"),
        F.lit(0).cast("bigint").alias("seq"),
        F.col("url"),
        F.lit(0).alias("depth"),
    )
    state = stored_by(
        seeds.select("url").distinct().select(
            F.col("url").alias("seed"),
            urls.canonical_domain(F.col("url")).alias("seed_domain"),
            F.array(start).cast(f"array<{_QUEUED}>").alias("heads"),
            F.array().cast(_VISITS).alias("visits"),
        ),
        "seed",
    )
    first = state.select("seed", F.inline("heads"))
    origin, known, owners = state, [], state.count()
    for round_no in range(1, spec.crawl_max_pages + 1):
        found = crawl_round(state, archive, known, round_no, spec.same_domain_only, known_rows=owners)
        # Behind an anti join the rows lie with their (seed, URL) already.
        found = stored_by(found, ["seed", "url"], deal=not known)
        if found.isEmpty():  # no seed had a URL left
            break
        before, state = state, stored_by(_advance(state, found, round_no, spec.crawl_max_pages - round_no), "seed")
        if before is not origin:
            drop_stored(before)
        known.append(found)
        if len(known) == MAX_TABLES:
            together = stored_by(reduce(DataFrame.unionByName, known).filter("is_link"), ["seed", "url"], deal=True)
            for table in known:
                drop_stored(table)
            known = [together]
    visits = state.select("seed", F.inline("visits")).withColumnRenamed("rank", "visit_rank")
    columns = ["seed", "minus", "seq", "url", "depth"]
    queued = reduce(
        DataFrame.unionByName, [t.filter("is_link").select(*columns) for t in known], first.select(*columns)
    )
    return CrawlResult(visits, archive, queued)
