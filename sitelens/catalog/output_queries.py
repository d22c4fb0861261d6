"""Queries on what jobs write, on extensions, and on walks over captured links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.catalog import inputs as I
from sitelens.catalog.lead_queries import ORACLE as LEAD_ORACLE
from sitelens.catalog.lead_queries import SETTINGS
from sitelens.catalog.page_queries import _NAV_HREFS, _NAV_LINKS, _NAV_TEXTS, _SAME
from sitelens.catalog.registry import Registry, scratch
from sitelens.catalog.sql import distinct_list, norm
from sitelens.catalog.walk_queries import _CARDS, _WALK_SPEC, _WALKED, PRIORITY, _targets, archive
from sitelens.functions import urls
from sitelens.functions.transforms import register_transform
from sitelens.operators.crawl import MISSING_PAGE, crawl
from sitelens.operators.extract import Extractor, extract_fields, register_extractor
from sitelens.operators.modules import register_module, run_modules
from sitelens.operators.records import process_records
from sitelens.operators.shred import NodeNeeds
from sitelens.plans.directory import directory_list
from sitelens.plans.spec import read_fields, read_spec
from sitelens.sources.pages import number_pages, page_archive, store_raw_pages
from sitelens.sources.seeds import read_csv
from sitelens.sources.sinks import union_rows, write_results, write_with_cleaned

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle


# -- outputs ------------------------------------------------------------------------


@query(
    "raw_page_store",
    f"""
WITH s AS (SELECT *, regexp_extract(url, '//([^/]+)', 1) AS seed FROM ({I.as_sql(I.SITE_PAGES)}) p WHERE error IS NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY page_id) AS place FROM (
  SELECT *, regexp_extract(url, '//([^/]+)', 1) AS seed FROM ({I.as_sql(I.SITE_PAGES)}) p) q)
SELECT n.seed, concat('page_', lpad(CAST(n.place AS VARCHAR), CAST(greatest(3, len(CAST(n.place AS VARCHAR))) AS INT), '0'), '_',
  replace(array_to_string(string_split(regexp_extract(n.url, '//[^/]+/(.*)$', 1), '/')[-2:], '_'), '-', '_')) AS label,
  n.url, md5(n.html) AS html_md5
FROM n JOIN s ON s.page_id = n.page_id
""",
)
def raw_page_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw pages stored under their labels; pages that were not fetched have none."""
    pages = archive(spark, sf_dir).select(
        F.regexp_extract("url", "//([^/]+)", 1).alias("seed"),
        F.col("page_id").alias("visit_rank"),
        "url",
        F.when(F.col("error").isNull(), F.col("html")).alias("html"),
    )
    path = scratch(pages, "raw")
    store_raw_pages(number_pages(pages), path)
    stored = spark.read.schema("seed string, label string, url string, html string").parquet(path)
    return stored.select("seed", "label", "url", F.md5("html").alias("html_md5"))


_CELLS = ", ".join(f"coalesce({c}, '') AS {c}" for c in ("firm", "name", "url", "email", "phone"))


@query(
    "cleaned_output",
    f"""
SELECT 'cleaned' AS output, {_CELLS} FROM ({LEAD_ORACLE["lead_clean"]}) c
UNION ALL SELECT 'standard', coalesce(law_firm, ''), coalesce(name, ''), coalesce(website, ''), coalesce(email, ''), coalesce(phone, '')
FROM ({I.as_sql(I.LEADS)}) l
""",
)
def cleaned_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The standard CSV of leads and, beside it, the cleaned one."""
    leads = I.derive(spark, sf_dir, I.LEADS, I.texts)
    path = scratch(leads, "leads")
    done = write_with_cleaned(leads.orderBy("idx"), path, {**SETTINGS, "enabled": True}, ["name"])
    if not done["success"]:
        raise RuntimeError(done["error"])
    names = {"law_firm": "firm", "website": "url"}
    cells = [F.coalesce(c, F.lit("")).alias(c) for c in ("firm", "name", "url", "email", "phone")]
    parts = [
        read_csv(spark, f"{path}/{file}").withColumnsRenamed(names).select(F.lit(output).alias("output"), *cells)
        for output, file in (("standard", "results.csv"), ("cleaned", "cleaned_results.csv"))
    ]
    return parts[0].unionByName(parts[1])


@query(
    "job_output",
    f"""
WITH RECURSIVE {_WALKED}, {_CARDS}
SELECT 'go; input_url; fax; title; source_url; page_url; tags' AS column_order, target AS input_url, url AS source_url,
  url AS page_url, title, coalesce(go, '') AS go, tags, '' AS fax
FROM cards
""",
)
def job_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results as a job writes them: the configured columns in their order, also one that no
    row has, then the others."""
    pages = archive(spark, sf_dir)
    shaping = {**_WALK_SPEC["output"]["shaping"], "field_order": ["go"]}
    spec = {
        **_WALK_SPEC,
        "schema": {"columns": ["input_url", "fax", "title", "go"]},
        "output": {"shaping": shaping},
    }
    path = scratch(pages, "job")
    write_results(directory_list(pages, _targets(pages), spec), path, shaping)
    back = read_csv(spark, f"{path}/results.csv")
    cells = [F.coalesce(c, F.lit("")).alias(c) for c in back.columns]
    return back.select(F.lit("; ".join(back.columns)).alias("column_order"), *cells)


@query(
    "union_rows",
    """
SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, NULL AS url FROM customer
UNION ALL SELECT page_id, NULL, NULL, url FROM pages
UNION ALL SELECT p_partkey, p_name, NULL, NULL FROM part
""",
)
def union_rows_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda name: I.table(spark, sf_dir, name)
    return union_rows(
        read("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")),
        read("pages").select("url", F.col("page_id").alias("id")),
        read("part").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("id")),
    )


# -- extension points ---------------------------------------------------------------


@query(
    "custom_extractor",
    f"""
SELECT page_id, CAST(len(t) AS VARCHAR) AS items, array_to_string({distinct_list('h')}, '; ') AS slashes
FROM (SELECT page_id, {_NAV_TEXTS} AS t, list_transform({_NAV_HREFS}, lambda x: concat(x, '/')) AS h FROM pages) p
""",
)
def custom_extractor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two extractors that a user adds: one counts elements, one makes a list of attributes."""
    register_extractor(
        "catalog.list_items",
        Extractor(
            lambda page: F.size(F.filter(page.nodes, lambda n: n.tag == "li")).cast("string"),
            needs=NodeNeeds(tags=frozenset(["li"])),
        ),
    )
    register_extractor(
        "catalog.slashed_links",
        Extractor(
            lambda page: F.array_distinct(
                F.transform(
                    F.filter(page.nodes, lambda n: (n.tag == "a") & n.attrs["href"].startswith("/")),
                    lambda n: F.concat(n.attrs["href"], F.lit("/")),
                )
            ),
            is_list=True,
            needs=NodeNeeds(tags=frozenset(["a"]), attrs=frozenset(["href"])),
        ),
    )
    fields = read_fields(
        [{"name": "items", "type": "catalog.list_items"}, {"name": "slashes", "type": "catalog.slashed_links"}]
    )
    found = extract_fields(I.texts(spark, sf_dir, "pages"), fields, ["page_id"])
    return found.select("page_id", "items", F.array_join("slashes", "; ").alias("slashes"))


@query(
    "custom_transform",
    "SELECT c_custkey, concat('C', regexp_replace(c_name, '[0-9]{6}', '######'), '!') AS name FROM customer",
)
def custom_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transform that a user adds, with an option, between built-in ones."""
    register_transform(
        "catalog.mask_digits",
        lambda c, options: F.regexp_replace(c, f"[0-9]{{{int(options['count'])}}}", "#" * int(options["count"])),
    )
    fields = read_fields(
        [
            {
                "name": "name",
                "transforms": [
                    "trim", {"name": "catalog.mask_digits", "count": 6},
                    {"name": "regex_replace", "pattern": "^(.*)$", "replacement": r"C\1!"},
                ],
            }
        ]
    )
    names = I.table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit(" "), "c_name").alias("name"))
    return process_records(names, fields)


@query(
    "custom_module",
    "SELECT c_custkey AS id, lower(c_name) AS name FROM customer WHERE c_nationkey = 3",
)
def custom_module(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cleaner module that a user adds, in a pipeline with built-in ones."""
    register_module("catalog.keep_equal", lambda df, options: df.filter(F.col(options["column"]) == options["value"]))
    customers = I.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    rows, _ = run_modules(
        customers,
        [
            {"module": "catalog.keep_equal", "options": {"column": "c_nationkey", "value": 3}},
            {"module": "core.rename_columns", "options": {"mapping": {"c_custkey": "id", "c_name": "name"}}},
            {"module": "text.normalize_case", "options": {"columns": ["name"], "case": "lower"}},
        ],
    )
    return rows.drop("c_nationkey")


# -- walks over captured links ------------------------------------------------------


def _captured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured pages under their own URLs, the first capture of each."""
    pages = I.texts(spark, sf_dir, "pages").select(
        "page_id",
        urls.normalize_url("url").alias("requested_url"),
        urls.normalize_url("url").alias("url"),
        F.lit(200).alias("status_code"),
        F.lit(None).cast("string").alias("error"),
        "html",
    )
    return page_archive(pages, "page_id")


_FIRSTS = f"firsts AS (SELECT {norm('url')} AS page, min(page_id) AS page_id FROM pages GROUP BY 1)"


@query(
    "captured_crawl",
    f"""
WITH {_NAV_LINKS.format(source='SELECT * FROM pages')}, {_FIRSTS},
scored AS (
  SELECT l.page, l.pos, l.link_url,
    {" + ".join(f"CASE WHEN contains(lower(l.link_url), '{w}') THEN 10 ELSE 0 END + CASE WHEN contains(lower(l.anchor_text), '{w}') THEN 5 ELSE 0 END" for w in PRIORITY)}
    + CASE WHEN len(l.link_url) - len(replace(l.link_url, '/', '')) <= 3 THEN 2 ELSE 0 END
    + CASE WHEN contains(lower(l.link_url), 'contact') OR contains(lower(l.anchor_text), 'contact') THEN 3 ELSE 0 END AS score
  FROM links l WHERE l.page_id IN (SELECT page_id FROM firsts) AND {_SAME} AND l.link_url <> l.page),
best AS (SELECT page, link_url, max(score) AS score, min(pos) AS pos FROM scored GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY score DESC, len(link_url), pos) AS n FROM best)
SELECT page AS seed, 'visit' AS kind, CAST(1 AS BIGINT) AS place, page AS url, CAST(10000 AS BIGINT) AS score, NULL AS error FROM firsts
UNION ALL SELECT page, CASE WHEN n <= 2 THEN 'visit' ELSE 'queued' END, CASE WHEN n <= 2 THEN n + 1 ELSE n - 2 END, link_url, score,
  CASE WHEN n <= 2 THEN '{MISSING_PAGE}' END FROM ranked
""",
)
def captured_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans that follow the links of the captured pages, and what is left in their queues."""
    pages = _captured(spark, sf_dir)
    spec = read_spec({"crawl": {"max_pages": 3, "priority_keywords": PRIORITY}})
    found = crawl(pages, pages.select("url"), spec)
    queued = found.frontier.select(
        "seed", F.lit("queued").alias("kind"), F.col("queue_rank").cast("bigint").alias("place"), "url",
        F.col("score").cast("bigint").alias("score"), F.lit(None).cast("string").alias("error"),
    )
    links = found.archive.select(F.col("pop_url").alias("seed"), F.inline("links")).select(
        "seed", "url", F.col("score").cast("bigint").alias("score")
    )
    visits = found.visits.join(links, ["seed", "url"], "left").select(
        "seed", F.lit("visit").alias("kind"), F.col("visit_rank").cast("bigint").alias("place"), "url",
        F.when(F.col("visit_rank") == 1, 10000).otherwise(F.col("score")).cast("bigint").alias("score"), "error",
    )
    return visits.unionByName(queued)


@query(
    "captured_directory",
    f"""
WITH {_FIRSTS},
p AS (
  SELECT f.page, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS origin, {_NAV_TEXTS} AS t, {_NAV_HREFS} AS h
  FROM pages JOIN firsts f ON f.page_id = pages.page_id),
e AS (SELECT page, origin, unnest(t) AS label, unnest(h) AS href FROM p)
SELECT page AS input_url, page AS source_url, page AS page_url, lower(label) AS label, concat(origin, href) AS link FROM e
""",
)
def captured_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing records from the link lists of the captured pages."""
    pages = _captured(spark, sf_dir)
    spec = {
        "mode": "directory_list",
        "extraction": {
            "record_selector": {"css": "nav li"},
            "fields": [
                {"name": "label", "selector": "a", "transforms": ["lowercase"]},
                {"name": "link", "selector": "a", "attribute": "href"},
            ],
        },
    }
    targets = pages.select(F.col("page_id").alias("target_idx"), F.col("url").alias("target"))
    return directory_list(pages, targets, spec).rows
