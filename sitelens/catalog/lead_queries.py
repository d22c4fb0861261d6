"""Queries over leads: filtering, projection, keys, duplicate groups, winners."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.catalog import inputs as I
from sitelens.catalog.registry import Registry
from sitelens.functions import contacts, urls
from sitelens.operators import leads as L
from sitelens.operators.skew import cut_lineage, salted_join

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle

SETTINGS = {
    "rename_fields": {"law_firm": "firm", "website": "url"},
    "include_fields": ["firm", "name", "url", "email", "phone", "source_directory", "profile_url"],
    "required_fields": ["name"],
    "sort_fields": ["firm", "email"],
}

# The same rules as plain SQL. Websites are lower-cased hosts with a path.
_URL = (
    "CASE WHEN {c} = '' THEN '' WHEN starts_with({c}, 'http') THEN {n} ELSE concat('https://', {n}) END"
)


def _norm_site(c: str) -> str:
    lowered = f"concat(lower(regexp_extract({c}, '^((?:https?://)?[^/]+)', 1)), regexp_extract({c}, '^(?:https?://)?[^/]+(.*)$', 1))"
    bare = f"regexp_replace(regexp_replace({lowered}, '#.*$', ''), '/+$', '')"
    return _URL.format(c=c, n=bare)


_PREPARED = f"""
src AS ({I.as_sql(I.LEADS)}),
st AS (
  SELECT idx, trim(name) AS name, trim(law_firm) AS law_firm, trim(website) AS website, trim(email) AS email,
    trim(phone) AS phone, trim(source_directory) AS source_directory FROM src),
flagged AS (
  SELECT *, CASE WHEN coalesce(name, '') = '' THEN 'missing_required'
    WHEN regexp_matches(lower(coalesce(email, '')), 'sentry[.]io|wixpress[.]com|ingest[.]sentry|@example[.]com|johndoe') THEN 'junk_email'
    ELSE 'kept' END AS status FROM st),
proj AS (
  SELECT idx, status, law_firm AS firm, name, {_norm_site('website')} AS url, lower(email) AS email, phone,
    CASE WHEN source_directory IS NULL THEN NULL ELSE regexp_replace(source_directory, '/$', '') END AS source_directory, '' AS profile_url, website FROM flagged),
parts AS (
  SELECT *, regexp_replace(regexp_extract(url, '^https?://([^/:?]+)', 1), '^www[.]', '') AS host,
    list_transform(string_split(regexp_replace(coalesce(phone, ''), '[;,/|]+', '|', 'g'), '|'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS raw_phones,
    trim(regexp_replace(lower(CASE WHEN coalesce(firm, '') <> '' THEN firm ELSE name END), '[^a-z0-9]+', ' ', 'g')) AS company FROM proj),
cut AS (
  SELECT *, list_filter(list_transform(raw_phones, lambda x: CASE WHEN len(x) = 11 AND starts_with(x, '1') THEN substr(x, 2) ELSE x END), lambda x: len(x) BETWEEN 7 AND 15) AS phones,
    CASE WHEN host = '' THEN '' WHEN regexp_matches(host, '[.](ac|co|com|edu|gov|net|org)[.](au|jp|nz|uk)$')
      THEN array_to_string(string_split(host, '.')[-3:], '.') ELSE array_to_string(string_split(host, '.')[-2:], '.') END AS domain FROM parts),
keyed AS (
  SELECT *, CASE WHEN coalesce(email, '') <> '' THEN 'email' WHEN domain <> '' THEN 'domain' WHEN len(phones) > 0 THEN 'phone'
      WHEN company <> '' THEN 'company' ELSE 'none' END AS kind FROM cut),
prepared AS (
  SELECT *, CASE kind WHEN 'email' THEN [email] WHEN 'domain' THEN [domain] WHEN 'phone' THEN phones WHEN 'company' THEN [company] ELSE [] END AS keys,
    CAST(coalesce(email, '') <> '' AS INT) + CAST(url <> '' AS INT) + CAST(coalesce(firm, '') <> '' AS INT) + CAST(name <> '' AS INT)
      + CAST(source_directory IS NOT NULL AS INT) + CAST(phone IS NOT NULL AS INT) AS important,
    len(coalesce(email, '')) + len(url) + len(coalesce(firm, '')) + len(name) + len(coalesce(source_directory, '')) + len(coalesce(phone, '')) AS length
  FROM keyed)
"""
# Phone chains are at most six rows long, so six rounds of min-label reach the end.
_ROUND = """
p{b} AS (SELECT phone, min(label) AS label FROM (SELECT r.phone, m.label FROM pr r JOIN r{a} m ON m.idx = r.idx) x GROUP BY phone),
r{b} AS (SELECT r.idx, min(p.label) AS label FROM pr r JOIN p{b} p ON p.phone = r.phone GROUP BY r.idx)"""
_GROUPED = f"""
{_PREPARED},
pr AS (SELECT idx, unnest(keys) AS phone FROM prepared WHERE kind = 'phone' AND status = 'kept'),
r0 AS (SELECT DISTINCT idx, idx AS label FROM pr),
{','.join(_ROUND.format(a=i, b=i + 1).strip() for i in range(7))},
single AS (SELECT kind, keys[1] AS k, min(idx) AS label FROM prepared WHERE status = 'kept' AND kind IN ('email', 'domain', 'company') GROUP BY 1, 2),
grouped AS (
  SELECT q.*, coalesce(r7.label, s.label, q.idx) AS grp FROM prepared q
  LEFT JOIN r7 ON r7.idx = q.idx LEFT JOIN single s ON s.kind = q.kind AND s.k = q.keys[1] WHERE q.status = 'kept'),
best AS (
  SELECT grp, count(*) AS group_size, arg_max(idx, (important, important, length, -idx)) AS best_idx FROM grouped GROUP BY grp)
"""


def _prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.prepare_leads(I.derive(spark, sf_dir, I.LEADS, I.texts), L.read_settings(SETTINGS))


@query(
    "lead_filter_stats",
    f"WITH {_PREPARED} SELECT status, count(*) AS n FROM prepared GROUP BY status",
)
def lead_filter_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prepared(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(
    "lead_project",
    f"WITH {_PREPARED} SELECT idx, firm, name, url, email, phone, source_directory, profile_url FROM prepared WHERE status = 'kept'",
)
def lead_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prepared(spark, sf_dir).filter("status = 'kept'").select("idx", "row.*")


@query(
    "lead_keys",
    f"WITH {_PREPARED} SELECT idx, kind, array_to_string(keys, '; ') AS keys, CAST(important AS BIGINT) AS important, CAST(length AS BIGINT) AS length FROM prepared WHERE status = 'kept'",
)
def lead_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prepared(spark, sf_dir).filter("status = 'kept'").select(
        "idx", "kind", F.array_join("keys", "; ").alias("keys"),
        F.col("score.important").cast("bigint").alias("important"),
        F.col("score.length").cast("bigint").alias("length"),
    )


@query("lead_groups", f"WITH {_GROUPED} SELECT idx, grp AS group_first_idx FROM grouped")
def lead_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepared = cut_lineage(_prepared(spark, sf_dir).filter("status = 'kept'"))
    known = prepared.count()
    grouped = cut_lineage(L.with_groups(prepared, known).select("idx", "group_id"))
    firsts = grouped.groupBy("group_id").agg(F.min("idx").alias("group_first_idx"))
    return salted_join(grouped, firsts, ["group_id"], known_rows=known).drop("group_id")


@query(
    "lead_best",
    f"WITH {_GROUPED} SELECT grp AS first_idx, best_idx, group_size FROM best",
)
def lead_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepared = cut_lineage(_prepared(spark, sf_dir).filter("status = 'kept'"))
    return L.best_rows(L.with_groups(prepared, prepared.count())).select("first_idx", "best_idx", "group_size")


@query(
    "lead_clean",
    f"""
WITH {_GROUPED}
SELECT p.firm, p.name, p.url, p.email, p.phone, p.source_directory, p.profile_url
FROM best b JOIN prepared p ON p.idx = b.best_idx ORDER BY lower(coalesce(p.firm, '')), lower(coalesce(p.email, '')), b.grp
""",
)
def lead_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.clean_leads(I.derive(spark, sf_dir, I.LEADS, I.texts), SETTINGS, "idx").rows


@query(
    "lead_clean_stats",
    f"""
WITH {_GROUPED}
SELECT (SELECT count(*) FROM prepared) AS total_rows,
  (SELECT count(*) FROM prepared WHERE status = 'missing_required') AS filtered_missing_required,
  (SELECT count(*) FROM prepared WHERE status = 'junk_email') AS filtered_junk_email,
  (SELECT CAST(sum(group_size - 1) AS BIGINT) FROM best) AS duplicates_removed, (SELECT count(*) FROM best) AS written
""",
)
def lead_clean_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.clean_leads(I.derive(spark, sf_dir, I.LEADS, I.texts), SETTINGS, "idx").stats


@query(
    "lead_values",
    f"""
WITH {_PREPARED}
SELECT idx, lower(trim(coalesce(email, ''))) AS email, coalesce(domain, '') AS domain, coalesce(url, '') AS url,
  array_to_string(phones, '; ') AS phones, trim(regexp_replace(lower(firm), '[^a-z0-9]+', ' ', 'g')) AS company
FROM prepared
""",
)
def lead_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scalar normalizers one by one."""
    return I.derive(spark, sf_dir, I.LEADS, I.texts).select(
        "idx",
        contacts.normalize_email(F.col("email")).alias("email"),
        urls.normalize_domain("website").alias("domain"),
        F.coalesce(urls.normalize_url_value("website"), F.lit("")).alias("url"),
        F.array_join(contacts.normalize_phones(F.array("phone")), "; ").alias("phones"),
        contacts.normalize_company(F.col("law_firm")).alias("company"),
    )
