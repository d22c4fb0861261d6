"""Crawl replay against a plain queue per seed, and pages with very many links."""

import heapq
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from sitelens.operators import crawl as crawling
from sitelens.operators.crawl import MISSING_PAGE, crawl
from sitelens.operators.skew import drop_stored, stored_by
from sitelens.plans.spec import read_spec

DDL = "requested_url string, url string, status_code int, error string, html string"


def archive(spark, rows):
    return spark.createDataFrame([(u, f, 200, e, h) for u, f, e, h in rows], DDL)


def plain_scan(pages, seed, max_pages):
    """Visits and frontier of one seed, one URL after another. Links are (url, score)."""
    queue, known, seq, visits = [(-10_000, 0, seed, 0)], {seed}, 0, []
    while queue and len(visits) < max_pages:
        _, _, url, depth = heapq.heappop(queue)
        final, error, links = pages.get(url, (url, MISSING_PAGE, []))
        known.add(final)
        visits.append((url, final, depth, error))
        for link, score in links if error is None else []:
            if link not in known:
                known.add(link)
                seq += 1
                heapq.heappush(queue, (-score, seq, link, depth + 1))
    return visits, [(u, -m, d) for m, _, u, d in sorted(queue)]


@pytest.mark.parametrize("max_pages,tables", [(1, 8), (6, 8), (9, 2)])
def test_equals_a_queue_per_seed(spark, monkeypatch, max_pages, tables):
    monkeypatch.setattr(crawling, "MAX_TABLES", tables)
    draw = random.Random(max_pages)
    names = [f"https://s{n % 3}.test/{'contact-' if n % 7 == 0 else 'p'}{n}" for n in range(40)]
    score = lambda u: 13 + 2 if "contact" in u else 2
    rows, pages = [], {}
    for u in names:
        if draw.random() < 0.1:
            continue  # not in the archive
        final = draw.choice(names) if draw.random() < 0.2 else u
        error = "HTTP 500" if draw.random() < 0.1 else None
        linked = draw.sample(names, draw.randint(0, 9))
        rows.append((u, final, error, "".join(f"<a href='{k}'>x</a>" for k in linked)))
        same = [k for k in linked if k.split("/")[2] == "s0.test"]
        ranked = sorted(same, key=lambda k: (-score(k), len(k), linked.index(k)))
        pages[u] = (final, error, [(k, score(k)) for k in ranked])
    seeds = [n for n in names if "//s0." in n][:12]
    spec = read_spec({"crawl": {"max_pages": max_pages, "priority_keywords": ["contact"]}})
    found = crawl(archive(spark, rows), spark.createDataFrame([(s,) for s in seeds], "url string"), spec)
    visits, frontier = found.visits.collect(), found.frontier.collect()
    for seed in seeds:
        want_visits, want_frontier = plain_scan(pages, seed, max_pages)
        mine = sorted((r for r in visits if r.seed == seed), key=lambda r: r.visit_rank)
        assert [(r.url, r.final_url, r.depth, r.error) for r in mine] == want_visits
        left = sorted((r for r in frontier if r.seed == seed), key=lambda r: r.queue_rank)
        assert [r.queue_rank for r in left] == list(range(1, len(left) + 1))
        assert [(r.url, r.score, r.depth) for r in left] == want_frontier


def test_hub_pages(spark):
    """Two pages with 200,000 links each, most of them shared: rows, not a longer state row."""
    n, home = 200_000, "https://hub.test"
    page = lambda k, extra: "".join(f"<a href=/p{i}>x</a>" for i in range(k, k + n)) + extra
    rows = [
        (f"{home}/", f"{home}/", None, page(0, "<a href=/contact>c</a>")),
        (f"{home}/contact", f"{home}/contact", None, page(1000, "")),
    ]
    pages = archive(spark, rows)
    spec = read_spec({"crawl": {"max_pages": 3, "priority_keywords": ["contact"]}})
    started = time.time()
    found = crawl(pages, spark.createDataFrame([(f"{home}/",)], "url string"), spec)
    assert [r.url for r in found.visits.orderBy("visit_rank").collect()] == [f"{home}/", f"{home}/contact", f"{home}/p0"]
    left = found.frontier.agg(F.count("*"), F.countDistinct("url"), F.max("queue_rank")).first()
    assert tuple(left) == (n + 1000 - 1,) * 3
    assert time.time() - started < 240
    # What a seed carries from round to round stays short.
    state = found.visits.groupBy("seed").count().first()
    assert state["count"] == 3


def test_stored_tables_can_be_dropped(spark, tmp_path):
    table = stored_by(spark.range(10), "id")
    name, path = table.stored_as
    assert table.count() == 10
    drop_stored(table)
    assert not spark.catalog.tableExists(name)
    assert not os.path.exists(path.removeprefix("file:"))
