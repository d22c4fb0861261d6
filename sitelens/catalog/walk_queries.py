"""Queries that walk a page archive: ranking, crawls, pagination, directories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.catalog import inputs as I
from sitelens.catalog.registry import Registry, flatten_lists
from sitelens.operators import quality
from sitelens.operators.crawl import crawl
from sitelens.operators.links import rank_links, should_follow, with_links
from sitelens.operators.paginate import Walk, next_page_links, walk
from sitelens.operators.skew import cut_lineage
from sitelens.plans.directory import directory_detail, directory_list
from sitelens.plans.site_scan import site_scan
from sitelens.plans.spec import read_spec
from sitelens.sources.pages import label_pages, spread

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle

PRIORITY = ["contact", "about", "team"]
EXCLUDE = ["/p-1"]


def archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived page archive, stored once because the jobs read it repeatedly."""
    return spread(cut_lineage(I.derive(spark, sf_dir, I.SITE_PAGES)))


# -- links and crawls -----------------------------------------------------------

_SITE = I.as_sql(I.SITE_LINKS)
# All links of a generated page in order, with their scores.
_LINKS = f"""
site AS ({_SITE}),
mentions AS (
  SELECT page_id, url, 0 AS pos, a_url AS link, a_text AS txt FROM site UNION ALL SELECT page_id, url, 1, b_url, b_text FROM site
  UNION ALL SELECT page_id, url, 2, c_url, 'Seven on' FROM site UNION ALL SELECT page_id, url, 3, a_url, 'Go' FROM site
  UNION ALL SELECT page_id, url, 4, b_url, 'Go' FROM site UNION ALL SELECT page_id, url, 5, next_url, 'Next' FROM site WHERE next_id <> page_id),
scored AS (
  SELECT *, CASE WHEN contains(link, 'contact') THEN 10 ELSE 0 END + CASE WHEN contains(link, 'about') THEN 10 ELSE 0 END
    + CASE WHEN contains(link, 'team') THEN 10 ELSE 0 END + CASE WHEN contains(lower(txt), 'contact') THEN 5 ELSE 0 END
    + CASE WHEN contains(lower(txt), 'about') THEN 5 ELSE 0 END + CASE WHEN contains(lower(txt), 'team') THEN 5 ELSE 0 END
    + CASE WHEN len(link) - len(replace(link, '/', '')) <= 3 THEN 2 ELSE 0 END
    + CASE WHEN contains(link, 'contact') OR contains(lower(txt), 'contact') THEN 3 ELSE 0 END AS score
  FROM mentions WHERE NOT contains(link, '/p-1')),
best AS (SELECT page_id, url, link, max(score) AS score, min(pos) AS pos FROM scored GROUP BY 1, 2, 3),
ranked AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, len(link), pos) AS n FROM best)
"""


@query(
    "link_rank",
    f"WITH {_LINKS} SELECT page_id, n AS link_rank, link AS url, CAST(score AS BIGINT) AS score FROM ranked",
)
def link_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = with_links(archive(spark, sf_dir), ["page_id"])
    ranked = rank_links(F.col("links"), PRIORITY, exclude=EXCLUDE)
    return linked.select("page_id", F.posexplode(ranked).alias("i", "k")).select(
        "page_id", (F.col("i") + 1).cast("bigint").alias("link_rank"), F.col("k.url").alias("url"),
        F.col("k.score").cast("bigint").alias("score"),
    )


@query(
    "link_follow",
    f"""
WITH {_LINKS}
SELECT DISTINCT page_id, link, txt AS anchor,
  (contains(link, 'contact') OR contains(lower(txt), 'contact') OR contains(link, '/x/')) AND NOT contains(link, 'h1.') AS follow
FROM mentions
""",
)
def link_follow(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = with_links(archive(spark, sf_dir), ["page_id"])
    each = linked.select("page_id", F.explode("links").alias("k")).select(
        "page_id", F.col("k.url").alias("link"), F.col("k.anchor").alias("anchor")
    )
    follow = should_follow(F.col("link"), F.col("anchor"), ["Contact", "/x/"], ["h1."])
    return each.withColumn("follow", follow).distinct()


_CRAWL_SPEC = {
    "crawl": {
        "max_pages": 4, "priority_keywords": PRIORITY, "exclude_url_keywords": EXCLUDE,
        "same_domain_only": True,
    }
}
_QUEUE = "STRUCT(minus BIGINT, seq BIGINT, url VARCHAR, depth BIGINT)[]"
_CRAWL = f"""
{_LINKS},
lists AS (
  SELECT site.url, site.error, coalesce(list((r.link, r.score) ORDER BY r.n) FILTER (r.link IS NOT NULL AND site.error IS NULL), []) AS ls
  FROM site LEFT JOIN ranked r ON r.page_id = site.page_id GROUP BY 1, 2),
walk AS (
  SELECT url AS seed, CAST(1 AS BIGINT) AS visit_rank, url, CAST(0 AS BIGINT) AS depth, CAST([] AS {_QUEUE}) AS queue, [url] AS known FROM site
  UNION ALL
  SELECT seed, visit_rank + 1, q[1].url, q[1].depth, q[2:], known FROM (
    SELECT seed, visit_rank, list_concat(known, list_transform(fresh, lambda x: x[1])) AS known,
      list_sort(list_concat(queue, list_transform(fresh, lambda x, i: struct_pack(minus := CAST(-x[2] AS BIGINT), seq := visit_rank * 1000 + i, url := x[1], depth := depth + 1)))) AS q
    FROM (
      SELECT w.*, list_filter(l.ls, lambda x: regexp_extract(x[1], '//([^/]+)', 1) = regexp_extract(w.seed, '//([^/]+)', 1) AND NOT list_contains(w.known, x[1])) AS fresh
      FROM walk w JOIN lists l ON l.url = w.url WHERE w.visit_rank < 4) e) s
  WHERE len(q) > 0)
"""


@query(
    "crawl_replay",
    f"WITH RECURSIVE {_CRAWL} SELECT w.seed, w.visit_rank, w.url, w.depth, l.error FROM walk w JOIN lists l ON l.url = w.url",
)
def crawl_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = archive(spark, sf_dir)
    found = crawl(pages, pages.select("url"), read_spec(_CRAWL_SPEC))
    return found.visits.select(
        "seed", F.col("visit_rank").cast("bigint").alias("visit_rank"), "url",
        F.col("depth").cast("bigint").alias("depth"), "error",
    )


@query(
    "crawl_frontier",
    f"""
WITH RECURSIVE {_CRAWL},
last AS (
  SELECT seed, max(visit_rank) AS m FROM walk GROUP BY seed),
final AS (
  SELECT w.seed, list_sort(list_concat(w.queue, list_transform(
      list_filter(l.ls, lambda x: regexp_extract(x[1], '//([^/]+)', 1) = regexp_extract(w.seed, '//([^/]+)', 1) AND NOT list_contains(w.known, x[1])),
      lambda x, i: struct_pack(minus := CAST(-x[2] AS BIGINT), seq := w.visit_rank * 1000 + i, url := x[1], depth := w.depth + 1)))) AS q
  FROM walk w JOIN last ON last.seed = w.seed AND last.m = w.visit_rank JOIN lists l ON l.url = w.url)
SELECT seed, n AS queue_rank, q[n].url AS url, -q[n].minus AS score FROM (SELECT seed, q, unnest(range(1, len(q) + 1)) AS n FROM final) x
""",
)
def crawl_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = archive(spark, sf_dir)
    found = crawl(pages, pages.select("url"), read_spec(_CRAWL_SPEC))
    return found.frontier.select(
        "seed", F.col("queue_rank").cast("bigint").alias("queue_rank"), "url",
        F.col("score").cast("bigint").alias("score"),
    )


_SCAN_SPEC = {
    **_CRAWL_SPEC,
    "mode": "site_scan",
    "extraction": {
        "fields": [
            {"name": "page_title", "type": "page_title"},
            {"name": "emails", "type": "emails", "many": True, "default": [], "transforms": ["lowercase"]},
            {"name": "phones", "type": "phones", "many": True, "default": []},
            {"name": "headings", "type": "headings", "many": True, "default": []},
        ]
    },
    "output": {"shaping": {"join_fields": ["source_urls", "emails", "phones", "headings"], "exclude_fields": ["email_source_urls", "phone_source_urls"]}},
}


@query(
    "site_scan",
    f"""
WITH RECURSIVE {_CRAWL},
v AS (SELECT w.seed, w.visit_rank, w.url, s.page_id FROM walk w JOIN site s ON s.url = w.url WHERE s.error IS NULL),
it AS (
  SELECT seed, visit_rank, url, concat('Site ', page_id) AS title, concat('info', page_id % 40, '@example.org') AS email,
    concat('(410) 555-', lpad(CAST(page_id % 10000 AS STRING), 4, '0')) AS phone, page_id FROM v),
h AS (
  SELECT seed, visit_rank, unnest(CASE WHEN page_id % 3 = 0 THEN [concat('Card A ', page_id), concat('Card B ', page_id), 'No link'] ELSE [concat('Card A ', page_id), concat('Card B ', page_id)] END) AS heading,
    unnest([1, 2, 3]) AS k FROM it),
hd AS (SELECT seed, heading, min((visit_rank, k)) AS fa FROM h WHERE heading IS NOT NULL GROUP BY 1, 2),
hl AS (SELECT seed, string_agg(heading, '; ' ORDER BY fa) AS headings FROM hd GROUP BY 1),
ed AS (SELECT seed, email, min(visit_rank) AS fa FROM it GROUP BY 1, 2),
el AS (SELECT seed, string_agg(email, '; ' ORDER BY fa) AS emails FROM ed GROUP BY 1),
pd AS (SELECT seed, phone, min(visit_rank) AS fa FROM it GROUP BY 1, 2),
pl AS (SELECT seed, string_agg(phone, '; ' ORDER BY fa) AS phones FROM pd GROUP BY 1),
t AS (SELECT seed, arg_min(title, visit_rank) AS page_title, string_agg(url, '; ' ORDER BY visit_rank) AS source_urls FROM it GROUP BY 1)
SELECT t.seed AS input_url, t.source_urls, t.page_title, concat('x@y.org; ', el.emails) AS emails, pl.phones, hl.headings
FROM t JOIN el ON el.seed = t.seed JOIN pl ON pl.seed = t.seed JOIN hl ON hl.seed = t.seed
""",
)
def site_scan_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = archive(spark, sf_dir)
    seeds = pages.select(F.col("page_id").alias("target_idx"), "url")
    return site_scan(pages, seeds, _SCAN_SPEC).rows


@query(
    "site_scan_pages",
    f"""
WITH RECURSIVE {_CRAWL}
SELECT w.seed AS input_url, w.url AS page_url, CAST(200 AS INT) AS status_code, concat('Site ', s.page_id) AS page_title
FROM walk w JOIN site s ON s.url = w.url WHERE s.error IS NULL
""",
)
def site_scan_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per visited page instead of one per seed."""
    pages = archive(spark, sf_dir)
    seeds = pages.select(F.col("page_id").alias("target_idx"), "url")
    spec = {
        **_CRAWL_SPEC,
        "extraction": {"fields": [{"name": "page_title", "type": "page_title"}]},
        "output": {"merge_rows": False},
    }
    found = site_scan(pages, seeds, spec).rows
    return found.select("input_url", "page_url", "status_code", "page_title")


@query(
    "site_scan_targets",
    f"""
WITH RECURSIVE {_CRAWL}
SELECT w.seed AS target, count(*) AS pages_crawled, count(*) FILTER (s.error IS NULL) AS pages_succeeded,
  count(*) FILTER (s.error IS NOT NULL) AS pages_failed, count(*) FILTER (s.error IS NOT NULL) AS error_count
FROM walk w JOIN site s ON s.url = w.url GROUP BY w.seed
""",
)
def site_scan_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = archive(spark, sf_dir)
    seeds = pages.select(F.col("page_id").alias("target_idx"), "url")
    return site_scan(pages, seeds, _SCAN_SPEC).targets.drop("target_idx")


@query(
    "raw_page_labels",
    f"""
WITH site AS ({_SITE})
SELECT page_id, concat('page_', lpad(CAST(page_id AS STRING), CAST(greatest(3, len(CAST(page_id AS STRING))) AS INT), '0'), '_',
  replace(array_to_string(string_split(regexp_extract(url, '//[^/]+/(.*)$', 1), '/')[-2:], '_'), '-', '_')) AS label FROM site
""",
)
def raw_page_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_pages(archive(spark, sf_dir), "url", "page_id").select("page_id", "label")


# -- pagination -------------------------------------------------------------------

_WALK_SPEC = {
    "mode": "directory_list",
    "extraction": {
        "record_selector": {"css": "div.card"},
        "fields": [
            {"name": "title", "selector": "h2", "transforms": ["uppercase"]},
            {"name": "go", "selector": "a.go", "attribute": "href"},
            {"name": "tags", "selector": ".tag", "many": True, "default": ["none"]},
        ],
    },
    "pagination": {"enabled": True, "max_pages": 3, "next_page": "a.next"},
    "output": {"shaping": {"join_fields": {"tags": "+"}}},
}
_WALKED = f"""
site AS ({_SITE}),
w AS (
  SELECT page_id AS target_idx, url AS target, page_id, url, CAST(0 AS BIGINT) AS page_idx, [page_id] AS seen FROM site
  UNION ALL
  SELECT w.target_idx, w.target, n.page_id, n.url, w.page_idx + 1, list_append(w.seen, n.page_id)
  FROM w JOIN site c ON c.page_id = w.page_id JOIN site n ON n.page_id = c.next_id
  WHERE w.page_idx + 1 < 3 AND c.error IS NULL AND c.next_id <> c.page_id AND NOT list_contains(w.seen, c.next_id)),
ends AS (SELECT target_idx, arg_max(w, page_idx) AS e FROM w GROUP BY target_idx),
stops AS (
  SELECT ends.target_idx, e.target AS target, e.page_idx + 1 AS pages_visited,
    CASE WHEN s.error IS NOT NULL THEN 'fetch_failure' WHEN e.page_idx + 1 >= 3 THEN 'max_pages_reached'
         WHEN s.next_id = s.page_id THEN 'no_next_page_found' ELSE 'duplicate_next_page_detected' END AS stop_reason
  FROM ends JOIN site s ON s.page_id = e.page_id),
visits AS (SELECT w.*, s.error FROM w JOIN site s ON s.page_id = w.page_id)
"""


def _targets(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").alias("target_idx"), F.col("url").alias("target"))


def _walked(pages: DataFrame) -> Walk:
    spec = read_spec(_WALK_SPEC)
    return walk(cut_lineage(next_page_links(pages, spec)), _targets(pages), spec)


@query(
    "pagination_walk",
    f"""
WITH RECURSIVE {_WALKED},
f AS (SELECT target_idx, coalesce(string_agg(url, '; ' ORDER BY page_idx) FILTER (page_idx > 0), '') AS urls_followed FROM w GROUP BY 1)
SELECT s.target_idx, s.target, s.stop_reason, s.pages_visited, f.urls_followed FROM stops s JOIN f ON f.target_idx = s.target_idx
""",
)
def pagination_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = archive(spark, sf_dir)
    found = _walked(pages).targets.drop("errors")
    return flatten_lists(found.withColumn("pages_visited", F.col("pages_visited").cast("bigint")))


@query(
    "stop_reason_counts",
    f"WITH RECURSIVE {_WALKED} SELECT stop_reason, count(*) AS count FROM stops GROUP BY 1",
)
def stop_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = archive(spark, sf_dir)
    return quality.stop_reason_counts(_walked(pages).targets)


@query(
    "pagination_loops",
    f"""
WITH RECURSIVE {_WALKED.replace("< 3", "< 9").replace(">= 3", ">= 9")}
SELECT target_idx, stop_reason, pages_visited FROM stops
""",
)
def pagination_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walks long enough to come back to a page they have seen."""
    spec = read_spec({**_WALK_SPEC, "pagination": {**_WALK_SPEC["pagination"], "max_pages": 9}})
    pages = archive(spark, sf_dir)
    found = walk(cut_lineage(next_page_links(pages, spec)), _targets(pages), spec).targets
    return found.select("target_idx", "stop_reason", F.col("pages_visited").cast("bigint"))


@query(
    "pagination_off",
    f"""
WITH site AS ({_SITE})
SELECT CASE WHEN error IS NULL THEN 'pagination_disabled' ELSE 'fetch_failure' END AS stop_reason, count(*) AS count
FROM site GROUP BY 1
""",
)
def pagination_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = read_spec({**_WALK_SPEC, "pagination": {"enabled": False}})
    pages = archive(spark, sf_dir)
    found = walk(cut_lineage(next_page_links(pages, spec)), _targets(pages), spec)
    return quality.stop_reason_counts(found.targets)


# -- directories --------------------------------------------------------------------

_CARDS = """
cards AS (
  SELECT v.target_idx, v.target, v.page_idx, v.url, v.page_id, c.rec_idx, c.title, c.go, c.tags FROM visits v JOIN site s ON s.page_id = v.page_id,
  LATERAL (VALUES (0, concat('CARD A ', s.page_id), s.a_url, 't1+t2'), (1, concat('CARD B ', s.page_id), s.b_url, 'none'), (2, 'NO LINK', NULL, 'none')) c(rec_idx, title, go, tags)
  WHERE v.error IS NULL AND (c.rec_idx < 2 OR s.page_id % 3 = 0))
"""


@query(
    "directory_list",
    f"""
WITH RECURSIVE {_WALKED}, {_CARDS}
SELECT target AS input_url, url AS source_url, url AS page_url, title, go, tags FROM cards
""",
)
def directory_list_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = archive(spark, sf_dir)
    return directory_list(pages, _targets(pages), _WALK_SPEC).rows


_CAP = 150
_CAPPED = f"""
{_CARDS},
numbered AS (SELECT *, row_number() OVER (ORDER BY target_idx, page_idx, rec_idx) AS n FROM cards),
counts AS (
  SELECT v.target_idx, v.page_idx, count(c.rec_idx) AS k FROM visits v LEFT JOIN cards c ON c.target_idx = v.target_idx AND c.page_idx = v.page_idx
  WHERE v.error IS NULL GROUP BY 1, 2),
running AS (SELECT *, coalesce(sum(k) OVER (ORDER BY target_idx, page_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM counts),
cut AS (SELECT min((target_idx, page_idx)) AS c FROM running WHERE seen >= {_CAP} OR seen + k > {_CAP})
"""


@query(
    "record_cap",
    f"""
WITH RECURSIVE {_WALKED}, {_CAPPED}
SELECT target AS input_url, url AS source_url, url AS page_url, title, go, tags FROM numbered WHERE n <= {_CAP}
""",
)
def record_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = archive(spark, sf_dir)
    spec = {**_WALK_SPEC, "limits": {"max_records": _CAP}}
    return directory_list(pages, _targets(pages), spec).rows


@query(
    "record_cap_limits",
    f"""
WITH RECURSIVE {_WALKED}, {_CAPPED}
SELECT CAST({_CAP} AS BIGINT) AS max_records, CAST(NULL AS BIGINT) AS max_detail_pages, (SELECT c IS NOT NULL FROM cut) AS max_records_hit,
  (SELECT CAST(coalesce(sum(k - greatest({_CAP} - seen, 0)) FILTER ((target_idx, page_idx) = cut.c), 0) AS BIGINT) FROM running, cut) AS records_truncated,
  false AS max_detail_pages_hit, CAST(0 AS BIGINT) AS detail_pages_skipped_due_to_limit
""",
)
def record_cap_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = archive(spark, sf_dir)
    spec = {**_WALK_SPEC, "limits": {"max_records": _CAP}}
    return directory_list(pages, _targets(pages), spec).limits


@query(
    "directory_counters",
    f"""
WITH RECURSIVE {_WALKED}, {_CARDS},
c AS (SELECT target_idx, count(*) AS k FROM cards GROUP BY 1),
v AS (SELECT target_idx, count(*) AS n, count(*) FILTER (error IS NULL) AS ok FROM visits GROUP BY 1)
SELECT count(*) AS target_count, CAST(sum(v.n) AS BIGINT) AS pages_crawled, CAST(sum(v.n) AS BIGINT) AS pages_visited,
  CAST(sum(v.ok) AS BIGINT) AS pages_succeeded, CAST(sum(v.n - v.ok) AS BIGINT) AS pages_failed,
  CAST(sum(coalesce(c.k, 0)) AS BIGINT) AS listing_count, CAST(sum(v.n - 1) AS BIGINT) AS pagination_urls_followed
FROM v LEFT JOIN c ON c.target_idx = v.target_idx
""",
)
def directory_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = archive(spark, sf_dir)
    report = directory_list(pages, _targets(pages), _WALK_SPEC).targets
    return quality.run_totals(
        report,
        ["pages_crawled", "pages_visited", "pages_succeeded", "pages_failed", "listing_count",
         "pagination_urls_followed"],
    )


_DETAIL_SPEC = {
    "mode": "directory_detail",
    "extraction": {
        "record_selector": {"css": "div.card"},
        "fields": [
            {"name": "title", "selector": "h2"},
            {"name": "detail_url", "selector": "a.go", "attribute": "href"},
        ],
        "detail_page": {
            "enabled": True,
            "url_field": "detail_url",
            "fields": [
                {"name": "email", "type": "emails", "transforms": ["lowercase"]},
                {"name": "site", "selector": "title"},
                {"name": "title", "selector": ".wide h2"},
            ],
        },
    },
    "output": {"shaping": {"join_fields": ["email"]}},
}
_DETAILED = f"""
site AS ({_SITE}),
visits AS (SELECT page_id AS target_idx, url AS target, 0 AS page_idx, url, page_id, error FROM site),
{_CARDS.replace("concat('CARD A '", "concat('Card A '").replace("concat('CARD B '", "concat('Card B '").replace("'NO LINK'", "'No link'")},
numbered AS (
  SELECT *, CASE WHEN go IS NOT NULL THEN row_number() OVER (PARTITION BY go IS NOT NULL ORDER BY target_idx, rec_idx) END AS attempt FROM cards),
joined AS (
  SELECT n.*, d.page_id AS d_id, d.error AS d_error FROM numbered n LEFT JOIN site d ON d.url = n.go AND n.attempt <= {{cap}})
"""
_DETAIL_ROWS = """
SELECT target AS input_url, url AS source_url, url AS page_url,
  CASE WHEN d_id IS NOT NULL AND d_error IS NULL THEN concat('Card B ', d_id) ELSE title END AS title,
  go AS detail_url, CASE WHEN d_id IS NOT NULL AND d_error IS NULL THEN concat('x@y.org; info', d_id % 40, '@example.org') END AS email,
  CASE WHEN d_id IS NOT NULL AND d_error IS NULL THEN concat('Site ', d_id) END AS site
FROM joined
"""


@query("detail_enrich", f"WITH {_DETAILED.format(cap=1000000000)} {_DETAIL_ROWS}")
def detail_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = archive(spark, sf_dir)
    return directory_detail(pages, _targets(pages), _DETAIL_SPEC).rows


@query("detail_cap", f"WITH {_DETAILED.format(cap=120)} {_DETAIL_ROWS}")
def detail_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = archive(spark, sf_dir)
    spec = {**_DETAIL_SPEC, "limits": {"max_detail_pages": 120}}
    return directory_detail(pages, _targets(pages), spec).rows


@query(
    "detail_issues",
    f"""
WITH {_DETAILED.format(cap=120)}
SELECT 'detail_page_fetch_failed' AS category, count(*) AS count FROM joined WHERE d_error IS NOT NULL
UNION ALL SELECT 'detail_page_limit_skipped', count(*) FILTER (attempt > 120) FROM joined HAVING count(*) FILTER (attempt > 120) > 0
UNION ALL SELECT 'max_detail_pages_reached', CAST(1 AS BIGINT) FROM joined HAVING count(*) FILTER (attempt > 120) > 0
UNION ALL SELECT 'directory_page_fetch_failed', count(*) FROM site WHERE error IS NOT NULL
""",
)
def detail_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = archive(spark, sf_dir)
    spec = {**_DETAIL_SPEC, "limits": {"max_detail_pages": 120}}
    return quality.issue_counts(directory_detail(pages, _targets(pages), spec).issues)


@query(
    "detail_counters",
    f"""
WITH {_DETAILED.format(cap=120)},
d AS (
  SELECT count(*) FILTER (attempt <= 120) AS tried, count(*) FILTER (d_id IS NOT NULL AND d_error IS NULL) AS got, count(*) AS listed FROM joined),
s AS (SELECT count(*) AS n, count(*) FILTER (error IS NULL) AS ok FROM site)
SELECT s.n AS target_count, s.n + d.tried AS pages_crawled, s.n AS pages_visited, s.ok + d.got AS pages_succeeded,
  s.n - s.ok + d.tried - d.got AS pages_failed, d.listed AS listing_count, d.tried AS detail_pages_attempted,
  d.got AS detail_pages_successful, d.tried - d.got AS detail_pages_failed, CAST(0 AS BIGINT) AS pagination_urls_followed
FROM s, d
""",
)
def detail_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = archive(spark, sf_dir)
    spec = {**_DETAIL_SPEC, "limits": {"max_detail_pages": 120}}
    report = directory_detail(pages, _targets(pages), spec).targets
    return quality.run_totals(report, [c for c in report.columns if c not in ("target_idx", "target", "stop_reason")])


_RENDERED_SPEC = {
    **_DETAIL_SPEC,
    "extraction": {
        "fields": [],
        "detail_page": {
            "enabled": True,
            "url_field": "detail_url",
            "fields": [{"name": "name", "xpath": "normalize-space((//h2)[1])"}],
        },
    },
    "metadata": {
        "renderer": "playwright", "private_only": True,
        "playwright": {"profile_link_selector": "nav a[href^='http']"},
    },
}


@query(
    "rendered_directory",
    f"""
WITH site AS ({_SITE}),
l AS (
  SELECT page_id, url, unnest([a_url, b_url, concat(c_url, '#x')]) AS link FROM site WHERE error IS NULL),
u AS (SELECT DISTINCT page_id, url, link FROM l)
SELECT u.url AS input_url, u.url AS source_url, u.url AS source_directory, u.url AS page_url,
  CASE WHEN d.error IS NULL THEN d.url ELSE u.link END AS detail_url,
  CASE WHEN d.error IS NULL THEN d.url ELSE u.link END AS profile_url,
  CASE WHEN d.error IS NULL THEN concat('Card A ', d.page_id) END AS name
FROM u JOIN site d ON d.url = regexp_replace(u.link, '#.*$', '')
""",
)
def rendered_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = archive(spark, sf_dir)
    return directory_detail(pages, _targets(pages), _RENDERED_SPEC).rows
