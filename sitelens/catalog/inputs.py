"""Inputs the registered queries derive from the given tables.

Each derived input is one SELECT that Spark and DuckDB both run; ``{pages}`` and
the like stand for the given tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sitelens.sources.pages import spread

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

HOST = "regexp_extract(url, '^https?://([^/?#]+)', 1)"

# Every page under a URL of its own on two hosts: three links to other pages, two or
# three listing cards, a next-page link for most pages, and below them the captured
# page. Its own links lead nowhere here and become plain text; its digits and @ become
# letters, so that contact data and headings are the planted ones.
_SITE = """
SELECT page_id, html AS captured, concat('https://www.h', CAST(page_id % 2 AS STRING), '.example.org',
         CASE page_id % 4 WHEN 0 THEN '/contact-' WHEN 1 THEN '/about/' WHEN 2 THEN '/p-'
              ELSE '/x/y/' END, CAST(page_id AS STRING)) AS url,
       (2 * page_id + 1) % (SELECT count(*) FROM {pages}) AS a_id,
       (2 * page_id + 2) % (SELECT count(*) FROM {pages}) AS b_id,
       (page_id + 7) % (SELECT count(*) FROM {pages}) AS c_id,
       (CASE WHEN page_id % 7 < 6 THEN page_id + 1
             WHEN page_id % 21 = 13 THEN page_id - 6
             WHEN page_id % 21 = 20 THEN page_id + 1
             ELSE page_id END) % (SELECT count(*) FROM {pages}) AS next_id
FROM {pages}
"""
SITE_LINKS = f"""
SELECT s.page_id, s.url, s.captured, s.next_id, a.url AS a_url, b.url AS b_url, c.url AS c_url,
       nx.url AS next_url,
       CASE WHEN a.page_id % 5 = 0 THEN 'Contact us' ELSE 'Page one' END AS a_text,
       CASE WHEN b.page_id % 6 = 0 THEN 'Our team' ELSE 'Page two' END AS b_text,
       CASE WHEN s.page_id % 11 = 10 THEN 'HTTP 500' END AS error
FROM ({_SITE}) s
JOIN ({_SITE}) a ON a.page_id = s.a_id
JOIN ({_SITE}) b ON b.page_id = s.b_id
JOIN ({_SITE}) c ON c.page_id = s.c_id
JOIN ({_SITE}) nx ON nx.page_id = s.next_id
"""
SITE_PAGES = f"""
SELECT page_id, url AS requested_url, url, CAST(200 AS INT) AS status_code, error,
  concat('<html><head><title>Site ', CAST(page_id AS STRING), '</title></head><body><nav>',
    '<a href="', a_url, '">', a_text, '</a><a href="', b_url, '">', b_text, '</a>',
    '<a href="', c_url, '#x">Seven on</a><a href="mailto:x@y.org">Mail</a></nav>',
    '<div class="card"><h2>Card A ', CAST(page_id AS STRING), '</h2><a class="go" href="', a_url,
    '">Go</a><span class="tag">t1</span><span class="tag">t2</span></div>',
    '<div class="card wide"><h2>Card B ', CAST(page_id AS STRING), '</h2><a class="go" href="', b_url,
    '">Go</a></div>',
    CASE WHEN page_id % 3 = 0 THEN '<div class="card"><h2>No link</h2></div>' ELSE '' END,
    CASE WHEN next_id = page_id THEN '' ELSE concat('<a class="next" href="', next_url, '">Next</a>') END,
    '<p class="mail">Write to Info', CAST(page_id % 40 AS STRING), '@Example.org or call (410) 555-',
    lpad(CAST(page_id % 10000 AS STRING), 4, '0'), '</p><section class="captured">',
    translate(replace(captured, '<a ', '<u '), '0123456789@', 'abcdefghij '), '</section></body></html>') AS html
FROM ({SITE_LINKS}) l
"""

# Captured pages as they are, with a contact footer on every page.
CONTACT_PAGES = f"""
SELECT page_id, url, CAST(floor(page_id / 8) AS BIGINT) AS seed_no,
  concat(html, '<section><p>Write to ',
    CASE page_id % 4 WHEN 0 THEN 'info@' WHEN 1 THEN 'jane@' WHEN 2 THEN 'support@' ELSE 'office@' END,
    {HOST}, ' or call (410) 555-', lpad(CAST(page_id % 10000 AS STRING), 4, '0'),
    '</p><a href="/contact">Contact</a><a href="/about-us">Who we are</a>',
    '<a href="https://www.facebook.com/p', CAST(page_id % 5 AS STRING), '">Social</a>',
    '<a href="tel:123">Call</a><a href="ftp://x.org/y">FTP</a></section>') AS html
FROM {{pages}}
"""

# Captures with the ways a fetch can go wrong.
# Captured pages with an address element, one that is too short to be an address,
# none, or one without a number; two of them have an address in their text.
ADDRESS_PAGES = """
SELECT page_id, url, concat(html, CASE page_id % 4
    WHEN 0 THEN concat('<address> ', CAST(page_id % 900 + 1 AS STRING), ' Quay  Street, Ghent</address>')
    WHEN 1 THEN '<div class="location">Pier 9</div><p>Find us at 77 Harbor Road, Suite 5, Portland, OR 97201!</p>'
    WHEN 2 THEN '<p>Find us at sea</p>'
    ELSE '<b itemprop="address">The old customs house</b><i>Post to 4 Dock Lane, Berth #12</i>' END) AS html
FROM {pages}
"""

CAPTURES = """
SELECT page_id, url, html,
  CASE WHEN page_id % 6 = 0 THEN regexp_replace(url, '^http:', 'https:') ELSE url END AS final_url,
  CASE page_id % 5 WHEN 0 THEN 'application/pdf' WHEN 1 THEN NULL
       WHEN 2 THEN 'application/xhtml+xml' ELSE 'Text/HTML; charset=utf-8' END AS content_type,
  CASE WHEN page_id % 13 = 12 THEN 'read timed out' END AS error
FROM {pages}
"""

# Leads from customers and pages with blanks, junk, collisions and phone chains.
LEADS = f"""
SELECT 2 * c_custkey AS idx, CASE WHEN c_custkey % 13 = 6 THEN NULL ELSE c_name END AS name,
  concat(CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE '' END, c_mktsegment, ' & Sons, Nr. ',
         CAST(c_nationkey AS STRING)) AS law_firm,
  CASE WHEN c_custkey % 5 = 1 THEN concat('www.Shop', CAST(c_custkey % 400 AS STRING), '.co.uk/a/') ELSE '' END AS website,
  CASE c_custkey % 5 WHEN 0 THEN concat(' Team', CAST(c_custkey % 300 AS STRING), '@Mail.org ')
       WHEN 4 THEN CASE WHEN c_custkey % 3 = 0 THEN 'a@ingest.sentry.net' ELSE NULL END ELSE '' END AS email,
  CASE WHEN c_custkey % 5 = 2 THEN concat('1-410-', substr(CAST(5550000 + CAST(floor(c_custkey / 5) AS BIGINT) AS STRING), 1, 3), '-',
         substr(CAST(5550000 + CAST(floor(c_custkey / 5) AS BIGINT) AS STRING), 4, 4),
         CASE WHEN CAST(floor(c_custkey / 5) AS BIGINT) % 6 = 5 THEN ' / 12'
              ELSE concat('; 410', CAST(5550001 + CAST(floor(c_custkey / 5) AS BIGINT) AS STRING)) END)
       ELSE NULL END AS phone,
  concat('http://dir.example.net/', c_mktsegment, '/') AS source_directory
FROM {{customer}}
UNION ALL
SELECT 2 * page_id + 1 AS idx, CASE WHEN page_id % 11 = 4 THEN '  ' ELSE concat('Page ', CAST(page_id AS STRING)) END AS name, '' AS law_firm,
  url AS website,
  CASE WHEN page_id % 3 = 0 THEN concat('info@', {HOST}) WHEN page_id % 7 = 1 THEN 'x@example.com' ELSE '' END AS email,
  NULL AS phone, NULL AS source_directory
FROM {{pages}}
"""

# A job ledger and its run reports from events.
JOBS = """
SELECT CAST(event_id AS STRING) AS job_id,
  CASE WHEN event_type = 'view' THEN 'queued' WHEN event_type = 'click' THEN 'running'
       WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS status,
  CAST(ts AS TIMESTAMP) AS created_at,
  CASE WHEN event_type = 'view' THEN NULL ELSE CAST(ts AS TIMESTAMP) + INTERVAL 5 SECOND END AS started_at,
  CASE WHEN event_type IN ('view', 'click') THEN NULL
       WHEN event_id % 3 = 0 THEN CAST(ts AS TIMESTAMP) + INTERVAL 65 SECOND
       WHEN event_id % 3 = 1 THEN CAST(ts AS TIMESTAMP) + INTERVAL 7 SECOND ELSE NULL END AS finished_at,
  event_id % 2 = 0 AS worker_alive,
  concat('/out/', CAST(event_id AS STRING)) AS output_dir,
  CAST(user_id AS STRING) AS client_ip, event_id, event_type
FROM {events}
"""
REPORTS = """
SELECT concat('/out/', CAST(event_id AS STRING)) AS output_dir, event_id,
  CASE event_id % 3 WHEN 0 THEN 'site_scan' WHEN 1 THEN 'directory_list' ELSE 'directory_detail' END AS mode,
  CAST(CASE WHEN event_id % 4 = 0 THEN -1 WHEN event_id % 4 = 1 THEN floor(value) ELSE 0 END AS BIGINT) AS row_count,
  CAST(event_id % 4 AS BIGINT) AS listing_count,
  CAST(CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id % 9 END AS BIGINT) AS pages_visited,
  CAST(event_id % 10 AS BIGINT) AS pages_crawled,
  CAST(event_id % 8 AS BIGINT) AS pagination_urls_followed,
  concat(CAST(event_id % 50 AS STRING), '.250s') AS duration,
  CASE event_id % 6 WHEN 0 THEN 'max_pages_reached' WHEN 1 THEN 'duplicate_next_page_detected'
       WHEN 2 THEN 'no_next_page_found' ELSE 'pagination_disabled' END AS stop_reason,
  CASE user_id % 6 WHEN 0 THEN 'GET: 403 Forbidden' WHEN 1 THEN 'Read TIMED OUT'
       WHEN 2 THEN 'DNS failure' ELSE 'weird' END AS error_text,
  CASE WHEN event_id % 5 = 0 THEN 'page_extraction_failed' WHEN event_id % 5 = 1 THEN 'detail_page_fetch_failed'
       ELSE 'other' END AS issue,
  event_id % 12 = 11 AS max_records_hit
FROM {events}
WHERE event_type <> 'view'
"""
SUBMISSIONS = """
SELECT event_id AS submission_id, CAST(ts AS TIMESTAMP) AS ts,
       CASE WHEN user_id % 20 = 3 THEN NULL ELSE CAST(user_id AS STRING) END AS client_ip
FROM {events}
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose values are about to be parsed, on as many cores as there are."""
    return spread(table(spark, sf_dir, name))


def derive(spark: SparkSession, sf_dir: str, sql: str, read=table) -> DataFrame:
    """Run a derived input on the tables of ``sf_dir``."""
    used = {t: read(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **used)


def as_sql(sql: str) -> str:
    """The same input for an engine where the tables are views."""
    return sql.format(**{t: t for t in TABLES})
