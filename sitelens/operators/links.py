"""Link tables: extraction, follow filters, scoring and ranking within a page."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.functions import text
from sitelens.operators.extract import LINK_NEEDS, page_links
from sitelens.operators.shred import shred


def with_links(pages: DataFrame, keep: Sequence[str], url: str = "url") -> DataFrame:
    """``keep`` columns, ``links`` array<url, anchor> and ``shred_error`` per page."""
    keep = list(dict.fromkeys([*keep, url]))
    return shred(pages, LINK_NEEDS, keep).select(
        *keep, page_links(url, "nodes", "texts").alias("links"), "shred_error"
    )


def explode_links(pages: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row per link with its position on the page."""
    return pages.select(
        *keep, F.posexplode("links").alias("pos", "link")
    ).select(*keep, "pos", F.col("link.url").alias("link_url"), F.col("link.anchor").alias("anchor_text"))


def link_score(url: Column, anchor: Column, priority: Sequence[str]) -> Column:
    url, anchor = F.lower(url), F.lower(anchor)
    score = F.lit(0)
    for keyword in priority:
        word = keyword.lower()
        score = score + F.when(url.contains(word), 10).otherwise(0)
        score = score + F.when(anchor.contains(word), 5).otherwise(0)
    slashes = F.length(url) - F.length(F.replace(url, F.lit("/"), F.lit("")))
    score = score + F.when(slashes <= 3, 2).otherwise(0)
    contact = url.contains("contact") | anchor.contains("contact")
    return score + F.when(contact, 3).otherwise(0)


def should_follow(
    url: Column, anchor: Column, include: Sequence[str], exclude: Sequence[str]
) -> Column:
    url, anchor = F.lower(url), F.lower(anchor)

    def mentioned(words: Sequence[str]) -> Column:
        verdict = F.lit(False)
        for word in words:
            verdict = verdict | url.contains(word.lower()) | anchor.contains(word.lower())
        return verdict

    allowed = mentioned(include) if include else F.lit(True)
    return allowed & ~mentioned(exclude)


def rank_links(
    links: Column,
    priority: Sequence[str],
    include: Sequence[str] = (),
    exclude: Sequence[str] = (),
) -> Column:
    """Links of one page in visiting order: array<url, score, pos>.

    Per URL the best score counts, at the position of its first mention. Order is
    by score, then shorter URL, then position. Everything happens inside the
    array of one page, so no row moves.
    """
    followed = F.filter(links, lambda k: should_follow(k.url, k.anchor, include, exclude))
    scored = F.transform(
        followed,
        lambda k, i: F.struct(
            k.url.alias("url"),
            (-link_score(k.url, k.anchor, priority)).alias("minus"),
            i.alias("pos"),
        ),
    )

    def first_per_url(entries: Column) -> Column:
        return text.let(
            F.array_sort(entries),
            lambda es: F.filter(es, lambda k, i: (i == 0) | (F.get(es, i - 1).url != k.url)),
        )

    def ranked(entries: Column) -> Column:
        best = first_per_url(entries)
        mentions = first_per_url(
            F.transform(
                entries,
                lambda k: F.struct(k.url.alias("url"), k.pos.alias("pos"), k.minus.alias("minus")),
            )
        )
        # Both lists are in URL order, one entry per URL.
        return F.zip_with(
            best,
            mentions,
            lambda b, m: F.struct(
                b.minus.alias("minus"),
                F.length(b.url).alias("length"),
                m.pos.alias("pos"),
                b.url.alias("url"),
            ),
        )

    return F.transform(
        F.array_sort(text.let(scored, ranked)),
        lambda k: F.struct(k.url.alias("url"), (-k.minus).alias("score"), k.pos.alias("pos")),
    )
