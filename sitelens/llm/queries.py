"""The registered queries of the operators, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.llm import (
    decontaminate,
    exact_dedup,
    jaccard_join,
    language,
    licenses,
    line_dedup,
    packing,
    periodic_runs,
    quality,
    secret_scan,
    token_alignment,
    toxicity,
    url_rules,
)
from sitelens.llm.common import remainder, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _register(run):
    QUERIES[run.__name__] = run
    return run


@_register
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contaminated (document, item) pairs with their tiles."""
    return decontaminate.contaminated_pairs(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


@_register
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.text_groups(table(spark, sf_dir, "documents"))


ORACLE["op8_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


@_register
def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similarity_classes(table(spark, sf_dir, "documents"))


@_register
def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(remainder(5) == 0, F.lit(False))
    found = language.identify(table(spark, sf_dir, "documents"), remainder(5) != 0)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


RULES = [
    ("net/", "block"),
    ("example.net/en/", "allow"),
    ("example.com/de/", "block"),
    ("org/fr/", "allow"),
]


@_register
def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), RULES)


ORACLE["op5_url_rules"] = """
WITH urls AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
judged AS (
  SELECT *, CASE
    WHEN ('.' || host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN ('.' || host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN ('.' || host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN ('.' || host LIKE '%.net') AND starts_with(path, '/') THEN 'net/'
  END AS rule FROM urls)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow'
    WHEN rule IS NOT NULL THEN 'block'
    WHEN regexp_matches(host || path, '(^|[./-])(cheap-pills?|spam-farms?|ads?-track(er|ing)?'
      || '|casino|free-bets|adult)([./-]|$)') THEN 'block'
    ELSE 'allow' END AS verdict
FROM judged
"""


@_register
def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@_register
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(remainder(3) == 1, F.lit(False))
    found = quality.score(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), remainder(3) != 1
    )
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted")


@_register
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(remainder(5) == 0, F.lit(False))
    found = toxicity.score(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), remainder(5) != 0
    )
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted", "terms")


@_register
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@_register
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document with the lines that alignment deletes from it."""
    return line_dedup.deleted_lines(table(spark, sf_dir, "documents"), every=True).drop("row")


@_register
def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.span_digest(secret_scan.find_secrets(table(spark, sf_dir, "documents")))


def _secrets_sql() -> str:
    """A match is found again by the texts between the matches that SQL splits off."""
    parts = []
    for k, rule in enumerate(secret_scan.RULES):
        pattern = ("(?i)" if rule.fold else "") + rule.pattern
        pattern = pattern.replace("\\x20", " ").replace("'", "''")
        group = 2 if rule.head else 0
        parts.append(
            f"""SELECT key, {k} AS rank, '{rule.kind}' AS kind, {rule.least} AS least,
       regexp_extract_all(text, '{pattern}') AS hits,
       regexp_extract_all(text, '{pattern}', {group}) AS measured,
       string_split_regex(text, '{pattern}') AS gaps
FROM docs WHERE regexp_matches(text, '{pattern}')"""
        )
    base = ", ".join(f"'{r.kind}'" for r in secret_scan.BASE_RULES)
    counts = ", ".join(
        f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in secret_scan.BASE_RULES
    )
    return f"""
WITH docs AS (SELECT row_number() OVER () AS key, doc_id, coalesce(text, '') AS text FROM documents),
found AS ({" UNION ALL ".join(parts)}),
steps AS (
  SELECT key, rank, kind, least, generate_subscripts(hits, 1) AS i, unnest(hits) AS hit,
         unnest(measured) AS part, unnest(gaps[:len(hits)]) AS gap FROM found),
placed AS (
  SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY key, rank ORDER BY i) AS stop FROM steps),
spans AS (
  SELECT key, rank, kind, stop - length(hit) AS start,
         kind || ':' || (stop - length(hit))::BIGINT || ':' || stop::BIGINT AS span
  FROM placed WHERE length(part) >= least),
per_doc AS (
  SELECT key, {counts},
         string_agg(span, ',' ORDER BY start, rank) FILTER (kind IN ({base})) AS base,
         string_agg(span, ',' ORDER BY start, rank) AS spans
  FROM spans GROUP BY key)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
       coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans
FROM docs LEFT JOIN per_doc USING (key)
"""


ORACLE["op11_secrets"] = _secrets_sql()


@_register
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic_runs.repeat_tails(table(spark, sf_dir, "documents"))
    return periodic_runs.run_digest(periodic_runs.find_runs(docs))


@_register
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(table(spark, sf_dir, "documents"), with_groups=False)
