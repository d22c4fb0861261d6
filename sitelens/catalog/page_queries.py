"""Queries over captured pages: URLs, links, gates, extraction, merging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.catalog import inputs as I
from sitelens.catalog.registry import Registry, flatten_lists, scratch
from sitelens.catalog.sql import EMAILS, HOST, PHONES, UNESCAPED, distinct_list, norm, tidy
from sitelens.functions.cells import list_cell
from sitelens.functions import text, urls
from sitelens.operators.context import join_context
from sitelens.operators.extract import Page, extract_fields, shred_for
from sitelens.operators.links import explode_links, with_links
from sitelens.operators.listing import explode_records, listing_needs, listing_records
from sitelens.operators.merge import contact_summary, merge_items, merge_pages, merge_scalars
from sitelens.operators.skew import cut_lineage
from sitelens.plans.spec import read_fields
from sitelens.sources.pages import gate_pages, page_archive
from sitelens.sources.seeds import (
    assemble_targets,
    read_csv,
    read_csv_seeds,
    read_json_seeds,
    read_text_seeds,
)
from sitelens.sources.sinks import write_csv, write_json

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle

_DOMAIN = f"regexp_replace({HOST.format(u='url')}, '^www[.]', '')"


@query(
    "url_normalize",
    f"""
WITH p AS (SELECT page_id, {norm('url')} AS u, {_DOMAIN} AS d FROM pages)
SELECT page_id, u AS normalized, u AS from_upper, d AS domain,
  array_to_string(string_split(d, '.')[-2:], '.') AS root,
  concat('page_', lpad(CAST(page_id + 1 AS STRING), CAST(greatest(3, len(CAST(page_id + 1 AS STRING))) AS INT), '0'), '_',
    trim(regexp_replace(concat(array_to_string(list_filter(string_split(regexp_extract(u, '^https?://[^/]+(/[^?]*)', 1), '/'), lambda x: x <> '')[-2:], '_'),
      CASE WHEN contains(u, '?') THEN concat('_', regexp_replace(regexp_extract(u, '[?](.*)$', 1), '[=&]', '_', 'g')) ELSE '' END),
      '[^a-z0-9]+', '_', 'g'), '_')) AS label,
  regexp_replace(d, '[^a-z0-9]+', '_', 'g') AS slug, true AS is_http
FROM p
""",
)
def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = I.table(spark, sf_dir, "pages")
    # The same URL typed carelessly: blanks, upper-case host, default port, fragment.
    typed = F.concat(
        F.lit("\t "),
        F.regexp_extract("url", "^(https?://)", 1),
        F.upper(F.regexp_extract("url", "^https?://([^/?#]+)", 1)),
        F.when(F.col("url").startswith("https"), ":443").otherwise(":80"),
        F.regexp_extract("url", "^https?://[^/?#]+([^#]*)", 1),
        F.lit("#frag "),
    )
    df = pages.select("page_id", "url", typed.alias("typed")).select(
        "page_id", urls.normalize_url("url").alias("normalized"), urls.normalize_url("typed").alias("from_upper")
    )
    domain = urls.canonical_domain("normalized")
    return df.select(
        "page_id",
        "normalized",
        "from_upper",
        domain.alias("domain"),
        urls.root_domain(domain).alias("root"),
        urls.page_label(F.col("normalized"), F.col("page_id") + 1).alias("label"),
        text.slugify(domain).alias("slug"),
        urls.is_http_url(F.col("normalized")).alias("is_http"),
    )


_NAV_LINKS = f"""
raw AS (
  SELECT page_id, {norm('url')} AS page, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS origin,
    regexp_extract_all(html, '<a href="([^"]*)">[^<]*</a>', 1) AS hrefs,
    regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1) AS texts
  FROM ({{source}}) src),
flat AS (
  SELECT page_id, page, origin, unnest(hrefs) AS href, unnest(texts) AS anchor,
    generate_subscripts(hrefs, 1) AS n FROM raw),
kept AS (
  SELECT page_id, page, n,
    CASE WHEN starts_with(href, '/') THEN concat(origin, regexp_replace({UNESCAPED.format(c='href')}, '/+$', ''))
         WHEN starts_with(href, 'ftp:') THEN concat('https://', href) ELSE href END AS link_url,
    {tidy('anchor')} AS anchor_text
  FROM flat WHERE NOT regexp_matches(href, '^(mailto|tel|javascript|data):|^#')),
links AS (
  SELECT page_id, page, row_number() OVER (PARTITION BY page_id ORDER BY n) - 1 AS pos, link_url, anchor_text FROM kept)
"""


@query(
    "links_extract",
    f"WITH {_NAV_LINKS.format(source='SELECT * FROM pages')} SELECT page_id, pos, link_url, anchor_text FROM links",
)
def links_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = I.texts(spark, sf_dir, "pages").withColumn("url", urls.normalize_url("url"))
    found = explode_links(with_links(pages, ["page_id"]), ["page_id"])
    return found.withColumn("pos", F.col("pos").cast("bigint"))


def _contact_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = I.derive(spark, sf_dir, I.CONTACT_PAGES, I.texts)
    return pages.withColumn("url", urls.normalize_url("url"))


def _link_kind(condition: str) -> str:
    source = I.as_sql(I.CONTACT_PAGES)
    return f"""
WITH {_NAV_LINKS.format(source=source)},
firsts AS (SELECT page_id, link_url, min(pos) AS pos FROM links WHERE {condition} GROUP BY page_id, link_url)
SELECT p.page_id, coalesce(string_agg(f.link_url, '; ' ORDER BY f.pos), '') AS links
FROM pages p LEFT JOIN firsts f ON f.page_id = p.page_id GROUP BY p.page_id
"""


_SAME = (
    f"regexp_replace({HOST.format(u='link_url')}, '^www[.]', '') = "
    f"regexp_replace({HOST.format(u='page')}, '^www[.]', '')"
)
_CONTACT_WORDS = "contact|about|team|staff|office|location|get-in-touch"
_SOCIAL = "facebook[.]com|instagram[.]com|linkedin[.]com|twitter[.]com|x[.]com|youtube[.]com|tiktok[.]com"


def _one_link_field(kind: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        fields = read_fields([{"name": "links", "type": kind, "many": True}])
        found = extract_fields(_contact_pages(spark, sf_dir), fields, ["page_id"])
        return found.select("page_id", list_cell("links").alias("links"))

    return run


query("internal_links", _link_kind(_SAME))(_one_link_field("internal_links"))
query(
    "contact_links",
    _link_kind(
        f"{_SAME} AND (regexp_matches(lower(link_url), '{_CONTACT_WORDS}') OR regexp_matches(lower(anchor_text), '{_CONTACT_WORDS}'))"
    ),
)(_one_link_field("contact_links"))
query("social_links", _link_kind(f"regexp_matches(lower(link_url), '{_SOCIAL}')"))(
    _one_link_field("social_links")
)


@query(
    "page_gates",
    f"""
SELECT page_id, {norm('url')} AS requested_url,
  CASE WHEN error IS NULL THEN {norm('final_url')} ELSE final_url END AS url,
  coalesce(error, CASE WHEN content_type IS NULL THEN 'Unsupported content type: unknown'
     WHEN NOT regexp_matches(lower(content_type), 'html|xml') THEN concat('Unsupported content type: ', lower(content_type)) END) AS error,
  error IS NULL AND regexp_matches(lower(coalesce(content_type, '')), 'html|xml') AND url <> final_url AS redirected,
  CASE WHEN error IS NULL AND regexp_matches(lower(coalesce(content_type, '')), 'html|xml') THEN md5(html) END AS html_md5
FROM ({I.as_sql(I.CAPTURES)}) c
""",
)
def page_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = I.derive(spark, sf_dir, I.CAPTURES)
    gated = gate_pages(
        captures.select(
            "page_id", F.col("url").alias("requested_url"), F.col("final_url").alias("url"),
            "content_type", "error", "html",
        )
    )
    return gated.select(
        "page_id", "requested_url", "url", "error", "redirected", F.md5("html").alias("html_md5")
    )


_TITLE = tidy("regexp_extract(html, '<title>([^<]*)</title>', 1)")
_H1 = tidy("regexp_extract(html, '<h1>([^<]*)</h1>', 1)")


@query(
    "page_metadata",
    f"""
WITH p AS (SELECT page_id, {_TITLE} AS title, {_H1} AS h1 FROM pages)
SELECT page_id, nullif(title, '') AS page_title, h1 AS headings, 'none' AS meta_description,
  CASE WHEN len(string_split(h1, ' ')) BETWEEN 2 AND 8 THEN h1
       WHEN contains(title, ' | ') THEN trim(split_part(title, ' | ', 1))
       WHEN contains(title, ' - ') THEN trim(split_part(title, ' - ', 1))
       WHEN contains(title, ' :: ') THEN trim(split_part(title, ' :: ', 1))
       WHEN contains(title, ' / ') THEN trim(split_part(title, ' / ', 1))
       ELSE nullif(title, '') END AS business_name
FROM p
""",
)
def page_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = read_fields(
        [
            {"name": "page_title", "type": "page_title"},
            {"name": "headings", "type": "headings", "many": True, "default": []},
            {"name": "meta_description", "type": "meta_description", "default": "none"},
            {"name": "business_name", "type": "business_name"},
        ]
    )
    found = extract_fields(I.texts(spark, sf_dir, "pages"), fields, ["page_id"])
    return found.select(
        "page_id", "page_title", list_cell("headings").alias("headings"),
        "meta_description", "business_name",
    )


@query(
    "page_archive",
    """
SELECT requested_url, min(page_id) AS page_id FROM (
  SELECT page_id, regexp_replace(url, '[?#].*$', '') AS requested_url FROM pages
  UNION ALL SELECT page_id + 1000000, regexp_replace(url, '[?#].*$', '') FROM pages WHERE page_id % 3 = 0) x
GROUP BY 1
""",
)
def page_archive_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages captured again: those of one path, and every third page once more."""
    pages = I.table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_replace("url", "[?#].*$", "").alias("requested_url"), "html"
    )
    again = pages.filter("page_id % 3 = 0").withColumn("page_id", F.col("page_id") + 1000000)
    return page_archive(pages.unionByName(again), "page_id").select("requested_url", "page_id")


# A letter beyond ASCII is a word character, but none that an address may have.
_PLAIN = "regexp_replace(html, '[^\\x01-\\x7f]', '_', 'g')"
_ADDRESS = (
    r"(?i)\b\d{1,6}\s+[A-Z0-9][A-Z0-9\s.,#-]{6,120}\b"
    r"(?:,\s*[A-Z .''-]+,\s*[A-Z]{2}\s+\d{5}(?:-\d{4})?)?"
)


@query(
    "page_addresses",
    f"""
WITH p AS ({I.as_sql(I.ADDRESS_PAGES)})
SELECT page_id, CASE WHEN page_id % 4 = 0 THEN concat(CAST(page_id % 900 + 1 AS STRING), ' Quay Street, Ghent')
  ELSE coalesce(nullif(trim(regexp_replace(regexp_extract({_PLAIN}, '{_ADDRESS}', 0), '\\s+', ' ', 'g')), ''), 'none')
  END AS address
FROM p
""",
)
def page_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = read_fields([{"name": "address", "type": "address", "default": "none"}])
    found = extract_fields(I.derive(spark, sf_dir, I.ADDRESS_PAGES), fields, ["page_id"])
    return found.select("page_id", "address")


_NAV_TEXTS = "list_transform(regexp_extract_all(html, '<li><a href=\"[^\"]*\">([^<]*)</a></li>', 1), lambda x: {0})".format(tidy("x"))
_NAV_HREFS = "list_transform(regexp_extract_all(html, '<li><a href=\"([^\"]*)\">[^<]*</a></li>', 1), lambda x: {0})".format(UNESCAPED.format(c="x"))


@query(
    "selector_fields",
    f"""
WITH p AS (SELECT page_id, {_NAV_TEXTS} AS texts, {_NAV_HREFS} AS hrefs, html FROM pages)
SELECT page_id, array_to_string({distinct_list('texts')}, '; ') AS nav_texts, texts[1] AS first_nav,
  array_to_string({distinct_list('hrefs')}, '; ') AS nav_hrefs,
  {tidy("regexp_extract(html, '<article><h1>[^<]*</h1><p><b>([^<]*)<br>', 1)")} AS first_paragraph,
  {tidy("regexp_extract(html, '<div class=.ad.>([^<]*)</div>', 1)")} AS ad,
  regexp_extract(html, '<html lang=.([a-z]+).', 1) AS lang, 'missing' AS nothing
FROM p
""",
)
def selector_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = read_fields(
        [
            {"name": "nav_texts", "selector": "nav ul > li a[href]", "many": True},
            {"name": "first_nav", "selector": "nav a, footer a"},
            {"name": "nav_hrefs", "selector": "nav a", "attribute": "href", "many": True},
            {"name": "first_paragraph", "selector": "article > p"},
            {"name": "ad", "selector": "div.ad"},
            {"name": "lang", "selector": "html", "attribute": "lang"},
            {"name": "nothing", "selector": "#main .none", "default": "missing"},
        ]
    )
    found = extract_fields(I.texts(spark, sf_dir, "pages"), fields, ["page_id"])
    return flatten_lists(found.drop("url", "shred_error"))


@query(
    "xpath_fields",
    f"""
WITH p AS (SELECT page_id, {_NAV_TEXTS} AS texts, {_NAV_HREFS} AS hrefs, html FROM pages)
SELECT page_id, {_H1} AS h1, hrefs[1] AS first_href, array_to_string({distinct_list('hrefs')}, '; ') AS hrefs,
  array_to_string({distinct_list('texts')}, '; ') AS items, CAST(len(hrefs) AS STRING) AS n_links
FROM p
""",
)
def xpath_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = read_fields(
        [
            {"name": "h1", "xpath": "normalize-space((//article//h1)[1])"},
            {"name": "first_href", "xpath": "(//nav//a/@href)[1]"},
            {"name": "hrefs", "xpath": "//nav//a/@href", "many": True},
            {"name": "items", "xpath": "//ul/li", "many": True},
            {"name": "n_links", "xpath": "count(//nav//a)"},
        ]
    )
    found = extract_fields(I.texts(spark, sf_dir, "pages"), fields, ["page_id"])
    found = found.withColumn("n_links", F.regexp_replace("n_links", r"\.0$", ""))
    return flatten_lists(found.drop("url", "shred_error"))


@query(
    "xpath_axes",
    f"""
WITH p AS (SELECT page_id, {_NAV_TEXTS} AS texts, {_H1} AS h1,
  {tidy("regexp_extract(html, '<div class=.ad.>([^<]*)</div>', 1)")} AS ad FROM pages),
q AS (SELECT *, texts[1:2] AS two, texts[2:] AS after, list_filter(texts, lambda x: contains(x, 'e')) AS with_e,
  list_filter([ad, h1], lambda x: x <> '') AS heads, texts[:len(texts) - 1] AS before FROM p)
SELECT page_id, array_to_string({distinct_list('two')}, '; ') AS first_two,
  array_to_string({distinct_list('after')}, '; ') AS after_first, array_to_string({distinct_list('texts')}, '; ') AS owners,
  array_to_string({distinct_list('heads')}, '; ') AS heads, array_to_string({distinct_list('with_e')}, '; ') AS with_e,
  array_to_string({distinct_list('before')}, '; ') AS before_last, h1 AS found_by_position
FROM q
""",
)
def xpath_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of many elements by paths that no selector expresses."""
    fields = read_fields(
        [
            {"name": "first_two", "xpath": "//nav//li[position()<3]", "many": True},
            {"name": "after_first", "xpath": "//nav//li[1]/following-sibling::li", "many": True},
            {"name": "owners", "xpath": "//nav//li/a/..", "many": True},
            {"name": "heads", "xpath": "//article/h1 | //div[@class='ad']", "many": True},
            {"name": "with_e", "xpath": "//nav//a[@href and contains(text(), 'e')]", "many": True},
            {"name": "before_last", "xpath": "//ul[li/a]/li[last()]/preceding-sibling::*[self::li]", "many": True},
            {"name": "found_by_position", "xpath": "(//*[self::h1 or self::h2][normalize-space()])[1]"},
        ]
    )
    found = extract_fields(I.texts(spark, sf_dir, "pages"), fields, ["page_id"])
    return flatten_lists(found.drop("url", "shred_error"))


@query(
    "selector_forward",
    f"""
SELECT page_id, texts[3] AS third, texts[len(texts)] AS last, texts[len(texts) - 1] AS before_last, h1, 'utf-8' AS charset,
  {tidy("regexp_extract(html, '<div class=.ad.>([^<]*)</div>', 1)")} AS no_list
FROM (SELECT page_id, html, {_NAV_TEXTS} AS texts, {_H1} AS h1 FROM pages) p
""",
)
def selector_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selectors that depend on what comes later in the page."""
    fields = read_fields(
        [
            {"name": "third", "selector": "nav:has(li) li:nth-child(2 of :not(:first-child)) a"},
            {"name": "last", "selector": "nav li:last-child a"},
            {"name": "before_last", "selector": "li:has(+ li:last-child) > a"},
            {"name": "h1", "selector": "article:has(> h1) > h1:not(nav h1)"},
            {"name": "charset", "selector": "head > :is(meta, link):empty", "attribute": "charset"},
            {"name": "no_list", "selector": "body > :is(div, nav):not(:has(ul))"},
        ]
    )
    found = extract_fields(I.texts(spark, sf_dir, "pages"), fields, ["page_id"])
    return flatten_lists(found.drop("url", "shred_error"))


@query(
    "listing_records",
    f"""
WITH p AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS origin, {_NAV_TEXTS} AS texts, {_NAV_HREFS} AS hrefs FROM pages),
f AS (SELECT page_id, origin, unnest(texts) AS label, unnest(hrefs) AS href, generate_subscripts(texts, 1) - 1 AS rec_idx FROM p)
SELECT page_id, rec_idx, label, concat(origin, href) AS link, 'n/a' AS note FROM f
""",
)
def listing_records_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = read_fields(
        [
            {"name": "label", "selector": "a"},
            {"name": "link", "selector": "a[href^='/']", "attribute": "href"},
            {"name": "note", "selector": ".note", "default": "n/a"},
        ]
    )
    pages = I.texts(spark, sf_dir, "pages").withColumn("url", urls.normalize_url("url"))
    shredded = shred_for(pages, listing_needs("nav li", fields), ["page_id", "url"])
    page = Page(F.col("url"), F.col("nodes"), F.col("texts"), F.col("xhtml"), {}, F.lit(None))
    records = shredded.select("page_id", listing_records(page, "nav li", fields).alias("records"))
    return explode_records(records, ["page_id"]).withColumn("rec_idx", F.col("rec_idx").cast("bigint"))


# -- merging ------------------------------------------------------------------

_MERGE_FIELDS = [
    {"name": "page_title", "type": "page_title"},
    {"name": "emails", "type": "emails", "many": True, "default": []},
    {"name": "phones", "type": "phones", "many": True, "default": []},
    {"name": "contact_pages", "type": "contact_links", "many": True, "default": []},
]

def _seed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Processed page rows of seeds: eight consecutive pages are one seed's visits."""
    found = extract_fields(
        _contact_pages(spark, sf_dir), read_fields(_MERGE_FIELDS), ["page_id", "seed_no", "url"]
    )
    return cut_lineage(
        found.filter("shred_error IS NULL").withColumns(
            {
                "source_urls": F.array("url"),
                "email_source_urls": F.when(F.size("emails") > 0, F.array("url")),
                "phone_source_urls": F.when(F.size("phones") > 0, F.array("url")),
            }
        )
    )


_LISTS = ["source_urls", "email_source_urls", "phone_source_urls", "emails", "phones", "contact_pages"]


def _merged_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _seed_pages(spark, sf_dir)
    fields = {**{n: True for n in _LISTS}, "page_title": False}
    merged = merge_pages(pages, "seed_no", "page_id", fields, read_fields(_MERGE_FIELDS))
    seeds = pages.groupBy("seed_no").agg(F.min_by("url", "page_id").alias("input_url"))
    return merged.join(seeds, "seed_no")


_SEED_SQL = f"""
src AS ({I.as_sql(I.CONTACT_PAGES)}),
pg AS (
  SELECT page_id, seed_no, {norm('url')} AS url, {tidy("regexp_extract(html, '<title>([^<]*)</title>', 1)")} AS title,
    {EMAILS.format(c='html')} AS emails, {PHONES.format(c='html')} AS phones FROM src),
{_NAV_LINKS.format(source='SELECT * FROM src')},
contact AS (
  SELECT page_id, link_url AS item, pos FROM links
  WHERE {_SAME} AND (regexp_matches(lower(link_url), '{_CONTACT_WORDS}') OR regexp_matches(lower(anchor_text), '{_CONTACT_WORDS}'))),
items AS (
  SELECT seed_no, 'emails' AS field, unnest(emails) AS item, page_id, generate_subscripts(emails, 1) AS pos FROM pg
  UNION ALL SELECT seed_no, 'phones', unnest(phones), page_id, generate_subscripts(phones, 1) FROM pg
  UNION ALL SELECT seed_no, 'source_urls', url, page_id, 1 FROM pg
  UNION ALL SELECT seed_no, 'email_source_urls', url, page_id, 1 FROM pg WHERE len(emails) > 0
  UNION ALL SELECT pg.seed_no, 'contact_pages', item, pg.page_id, pos FROM contact JOIN pg ON pg.page_id = contact.page_id),
firsts AS (SELECT seed_no, field, item, min((page_id, pos)) AS fa FROM items GROUP BY seed_no, field, item),
lists AS (
  SELECT seed_no, list(item ORDER BY fa) FILTER (field = 'emails') AS emails,
    list(item ORDER BY fa) FILTER (field = 'phones') AS phones,
    list(item ORDER BY fa) FILTER (field = 'source_urls') AS source_urls,
    list(item ORDER BY fa) FILTER (field = 'email_source_urls') AS email_source_urls,
    list(item ORDER BY fa) FILTER (field = 'contact_pages') AS contact_pages
  FROM firsts GROUP BY seed_no),
seeds AS (
  SELECT seed_no, arg_min(url, page_id) AS input_url, arg_min(title, page_id) FILTER (title <> '') AS page_title
  FROM pg GROUP BY seed_no)
"""


@query(
    "site_merge",
    f"""
WITH {_SEED_SQL}
SELECT s.seed_no, s.input_url, s.page_title, array_to_string(l.emails, '; ') AS emails,
  array_to_string(l.phones, '; ') AS phones, array_to_string(l.source_urls, '; ') AS source_urls,
  coalesce(array_to_string(l.contact_pages, '; '), '') AS contact_pages
FROM seeds s JOIN lists l ON l.seed_no = s.seed_no
""",
)
def site_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = _merged_seeds(spark, sf_dir)
    return flatten_lists(merged.drop("email_source_urls", "phone_source_urls"))


@query(
    "contact_summary",
    f"""
WITH {_SEED_SQL},
e AS (SELECT seed_no, unnest(emails) AS email FROM lists),
er AS (
  SELECT e.seed_no, email, lower(email) AS low, {HOST.format(u='s.input_url')} AS host, split_part(lower(email), '@', 1) AS box,
    split_part(lower(email), '@', 2) AS dom FROM e JOIN seeds s ON s.seed_no = e.seed_no),
best_email AS (
  SELECT seed_no, arg_max(email, (CASE WHEN starts_with(box, 'info') THEN 7 WHEN starts_with(box, 'contact') THEN 6
      WHEN starts_with(box, 'hello') THEN 5 WHEN starts_with(box, 'intake') THEN 4 WHEN starts_with(box, 'office') THEN 3
      WHEN starts_with(box, 'admin') THEN 2 WHEN starts_with(box, 'support') THEN 1 ELSE 0 END,
    CASE WHEN dom = host OR dom = regexp_replace(host, '^www[.]', '') THEN 1 ELSE 0 END, low)) AS email
  FROM er GROUP BY seed_no),
c AS (SELECT seed_no, unnest(contact_pages) AS u FROM lists),
best_contact AS (
  SELECT seed_no, arg_max(u, (CASE WHEN contains(lower(u), '/contact') OR contains(lower(u), 'contact-us') THEN 3
    WHEN contains(lower(u), '/about') THEN 2 WHEN contains(lower(u), '/team') OR contains(lower(u), '/staff') THEN 1 ELSE 0 END, -len(u), lower(u))) AS u
  FROM c GROUP BY seed_no),
f AS (SELECT seed_no, unnest(email_source_urls) AS u FROM lists),
best_found AS (
  SELECT seed_no, arg_max(u, (CASE WHEN contains(lower(u), '/contact') OR contains(lower(u), 'contact-us') THEN 2
    WHEN contains(lower(u), '/about') OR contains(lower(u), '/team') THEN 1 ELSE 0 END, -len(u), lower(u))) AS u
  FROM f GROUP BY seed_no)
SELECT s.seed_no, be.email AS email, bc.u AS contact_page_url, bf.u AS email_found_on, l.phones[1] AS contact_phone
FROM seeds s JOIN lists l ON l.seed_no = s.seed_no LEFT JOIN best_email be ON be.seed_no = s.seed_no
LEFT JOIN best_contact bc ON bc.seed_no = s.seed_no LEFT JOIN best_found bf ON bf.seed_no = s.seed_no
""",
)
def contact_summary_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contact_summary(_merged_seeds(spark, sf_dir))
    return found.select("seed_no", "email", "contact_page_url", "email_found_on", "contact_phone")


def domain_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _seed_pages(spark, sf_dir)
    return pages.withColumn("domain", urls.canonical_domain("url"))


@query(
    "domain_merge",
    f"""
WITH {_SEED_SQL},
d AS (SELECT page_id, {_DOMAIN} AS domain, title FROM pg),
di AS (
  SELECT d.domain, i.field, i.item, min((i.page_id, i.pos)) AS fa FROM items i JOIN d ON d.page_id = i.page_id
  WHERE i.field IN ('emails', 'phones', 'contact_pages') GROUP BY 1, 2, 3),
t AS (SELECT domain, count(*) AS pages_merged, arg_min(title, page_id) FILTER (title <> '') AS page_title FROM d GROUP BY domain)
SELECT di.domain, t.pages_merged, t.page_title, di.field, di.item, di.fa[1] AS first_page
FROM di JOIN t ON t.domain = di.domain
""",
)
def domain_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merge by whole domain, in long form: a domain may hold any share of the pages."""
    pages = domain_pages(spark, sf_dir)
    items = merge_items(pages, ["domain"], "page_id", ["emails", "phones", "contact_pages"])
    heads = merge_scalars(pages, ["domain"], "page_id", ["page_title"])
    return items.join(heads, "domain").select(
        "domain", "pages_merged", "page_title", "field", "item", F.col("first_rank").alias("first_page")
    )


_WEBSITES = """
SELECT c.c_custkey, c.c_name, c.c_mktsegment, p.url AS website
FROM (SELECT c_custkey, c_name, c_mktsegment,
        (c_custkey * c_custkey) % (SELECT count(*) FROM {pages}) AS pid FROM {customer}) c
JOIN {pages} p ON p.page_id = c.pid
"""


@query(
    "context_join",
    f"""
WITH ctx AS (SELECT {norm('website')} AS input_url, c_custkey, c_name, website FROM ({I.as_sql(_WEBSITES)}) w),
r AS (SELECT page_id, {norm('url')} AS input_url, {_TITLE} AS c_name FROM pages)
SELECT r.page_id, r.input_url, nullif(r.c_name, '') AS c_name, ctx.c_custkey, ctx.website FROM r LEFT JOIN ctx ON ctx.input_url = r.input_url
""",
)
def context_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    contexts = I.derive(spark, sf_dir, _WEBSITES).select(
        urls.normalize_url("website").alias("input_url"), "c_custkey", "c_name", "website"
    )
    pages = I.texts(spark, sf_dir, "pages").withColumn("input_url", urls.normalize_url("url"))
    # The title column shares a name with a context column: the result wins.
    fields = read_fields([{"name": "c_name", "type": "page_title"}])
    rows = extract_fields(pages, fields, ["page_id", "input_url"]).select("page_id", "input_url", "c_name")
    return join_context(cut_lineage(rows), contexts)


@query(
    "target_assembly",
    f"""
WITH u AS (
  SELECT 0 AS src, c_custkey AS pos, {norm('website')} AS url FROM ({I.as_sql(_WEBSITES)}) w
  UNION ALL SELECT 1, page_id, {norm('url')} FROM pages),
d AS (SELECT url, min((src, pos)) AS fa FROM u GROUP BY url)
SELECT url, fa[1] AS src, fa[2] AS pos FROM d
""",
)
def target_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = I.derive(spark, sf_dir, _WEBSITES).select(
        F.col("c_custkey").alias("pos"), urls.normalize_url("website").alias("url")
    )
    pages = I.table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("pos"), urls.normalize_url("url").alias("url")
    )
    static = pages.select(F.lit(0).cast("bigint").alias("pos"), F.lit("https://unused/").alias("url"))
    found = assemble_targets(listed, pages, static=static)
    return found.select(
        "url",
        F.shiftright("target_idx", 54).cast("int").alias("src"),
        F.expr("target_idx & ((1L << 54) - 1)").alias("pos"),
    )


# -- sources and sinks: written, then read back ------------------------------------


@query("seeds_text", f"SELECT {norm('url')} AS url, count(*) AS n FROM pages GROUP BY 1")
def seeds_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = I.table(spark, sf_dir, "pages")
    path = scratch(pages, "seeds")
    lines = F.explode(F.array(F.concat(F.lit("  "), F.col("url"), F.lit(" ")), F.lit("# note"), F.lit(" ")))
    pages.select(lines.alias("value")).write.text(path)
    return read_text_seeds(spark, path).groupBy("url").agg(F.count(F.lit(1)).alias("n"))


# A seed file for each hundred pages, in the order of their ids, with all digits that a bigint has.
_PART = "lpad(CAST(floor(page_id / 100) AS STRING), 17, '0')"


def _numbered(seeds: DataFrame) -> DataFrame:
    """Seeds with the number of their file and their place in it."""
    return seeds.select(
        F.shiftright("pos", 33).alias("file"),
        F.col("pos").bitwiseAND(F.lit((1 << 33) - 1)).alias("place"),
        "url",
    )


@query(
    "seeds_files",
    f"SELECT CAST(floor(page_id / 100) AS BIGINT) AS file, 3 * (page_id % 100) AS place, {norm('url')} AS url FROM pages",
)
def seeds_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds of many text files, in the order of files and lines."""
    pages = I.table(spark, sf_dir, "pages")
    path = scratch(pages, "seeds")
    lines = pages.select(
        F.expr(_PART).alias("part"),
        "page_id",
        F.posexplode(F.array(F.concat(F.lit(" "), F.col("url")), F.lit("# note"), F.lit(" "))).alias("k", "value"),
    )
    in_order = lines.repartition("part").sortWithinPartitions("part", "page_id", "k")
    in_order.select("part", "value").write.partitionBy("part").text(path)
    return _numbered(read_text_seeds(spark, path))


@query(
    "seeds_json",
    f"""
SELECT CAST(floor(page_id / 100) AS BIGINT) AS file, page_id % 100 AS place,
  CASE WHEN page_id % 9 = 4 THEN NULL WHEN page_id % 9 = 7 THEN concat('https://', CAST(page_id AS VARCHAR), '/') ELSE {norm('url')} END AS url
FROM pages
""",
)
def seeds_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists and objects with a urls list by turns; some items are blank or numbers."""
    pages = I.table(spark, sf_dir, "pages")
    path = scratch(pages, "seeds")
    item = (
        F.when(F.col("page_id") % 9 == 4, F.lit('" "'))
        .when(F.col("page_id") % 9 == 7, F.col("page_id").cast("string"))
        .otherwise(F.to_json(F.array("url")).substr(F.lit(2), F.length(F.to_json(F.array("url"))) - 2))
    )
    listed = F.array_join(
        F.transform(F.sort_array(F.collect_list(F.struct("page_id", item.alias("i")))), lambda x: x.i), ",\n"
    )
    files = pages.groupBy(F.expr(_PART).alias("part")).agg(F.concat(F.lit("["), listed, F.lit("]")).alias("l"))
    odd = F.col("part").cast("bigint") % 2 == 1
    text_of = F.when(odd, F.concat(F.lit('{"note": 1, "urls": '), F.col("l"), F.lit("}"))).otherwise(F.col("l"))
    files.repartition("part").select("part", text_of.alias("value")).write.partitionBy("part").text(path)
    return _numbered(read_json_seeds(spark, path))


@query(
    "seeds_csv",
    f"SELECT {norm('url')} AS url, count(*) AS n FROM pages GROUP BY 1",
)
def seeds_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with quotes, separators and line breaks, as CSV files may have them."""
    pages = I.table(spark, sf_dir, "pages")
    path = scratch(pages, "seeds")
    rows = pages.select(
        F.concat(F.lit('Firm "A",\nhttps://not-a-seed.test/'), F.col("page_id").cast("string")).alias("name"),
        F.explode(F.array(F.col("url"), F.lit(" "))).alias("website"),
    )
    write_csv(rows, path)
    return read_csv_seeds(spark, path).groupBy("url").agg(F.count(F.lit(1)).alias("n"))


@query(
    "csv_round_trip",
    f"""
SELECT CAST(page_id AS STRING) AS page_id, array_to_string({distinct_list('t')}, '; ') AS nav, coalesce(title, '') AS page_title, '' AS extra
FROM (SELECT page_id, {_NAV_TEXTS} AS t, nullif({_TITLE}, '') AS title FROM pages) p
""",
)
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = read_fields(
        [{"name": "nav", "selector": "nav a", "many": True}, {"name": "page_title", "type": "page_title"}]
    )
    found = extract_fields(I.texts(spark, sf_dir, "pages"), fields, ["page_id"])
    path = scratch(found, "csv")
    write_csv(found.select("page_id", "nav", "page_title"), path, ["page_title", "extra"])
    back = read_csv(spark, path)
    return back.select(*[F.coalesce(c, F.lit("")).alias(c) for c in back.columns])


@query(
    "json_round_trip",
    f"SELECT page_id, array_to_string({distinct_list('t')}, '; ') AS nav FROM (SELECT page_id, {_NAV_TEXTS} AS t FROM pages) p",
)
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = read_fields([{"name": "nav", "selector": "nav a", "many": True}])
    found = extract_fields(I.texts(spark, sf_dir, "pages"), fields, ["page_id"])
    path = scratch(found, "json")
    write_json(found.select("page_id", "nav"), path)
    return flatten_lists(spark.read.schema("page_id bigint, nav array<string>").json(path))
