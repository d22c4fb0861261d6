"""Queries over documents and customers: values, transforms, shaping, quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.catalog import inputs as I
from sitelens.catalog.registry import Registry, flatten_lists, scratch
from sitelens.catalog.sql import EMAILS, PHONES, distinct_list
from sitelens.functions import text
from sitelens.operators import quality
from sitelens.operators.records import (
    cleanup_counters,
    process_records,
    shape_records,
    transform_warnings,
)
from sitelens.plans.clean_csv import clean_csv as clean_csv_plan
from sitelens.plans.spec import read_fields, read_shaping
from sitelens.sources.seeds import read_csv
from sitelens.sources.sinks import write_csv

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle


def _values(kind: str) -> str:
    return f"""
WITH d AS (SELECT doc_id, {kind.format(c='text')} AS found FROM documents)
SELECT doc_id, array_to_string({distinct_list('found')}, '; ') AS found, len({distinct_list('found')}) AS n FROM d
"""


@query("doc_emails", _values(EMAILS))
def doc_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = I.texts(spark, sf_dir, "documents").select("doc_id", text.extract_emails(F.col("text")).alias("found"))
    return flatten_lists(docs.withColumn("n", F.size("found").cast("bigint")))


@query("doc_phones", _values(PHONES))
def doc_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = I.texts(spark, sf_dir, "documents").select("doc_id", text.extract_phones(F.col("text")).alias("found"))
    return flatten_lists(docs.withColumn("n", F.size("found").cast("bigint")))


@query(
    "transform_documents",
    """
WITH d AS (SELECT doc_id, lang, source, text, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS flat FROM documents)
SELECT doc_id, CASE WHEN lang IN ('de', 'es') THEN 'Other' ELSE upper(lang) END AS lang,
  concat('Source ', regexp_extract(source, '(\\d+)$', 1)) AS source,
  md5(lower(flat)) AS text_md5, CASE WHEN lower(regexp_extract(flat, '^(\\S+) (\\S+)', 2)) NOT IN ('', 'de', 'es', 'n/a')
    THEN regexp_extract(flat, '^(\\S+) (\\S+)', 2) END AS second_word,
  CASE WHEN lower(regexp_replace(flat, '[.]$', '')) NOT IN ('', 'de', 'es', 'n/a') THEN md5(regexp_replace(flat, '[.]$', '')) END AS no_dot_md5
FROM d
""",
)
def transform_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = I.texts(spark, sf_dir, "documents").select(
        "doc_id", "lang", "source", F.col("text").alias("body"),
        F.col("text").alias("second_word"), F.col("text").alias("no_dot"),
    )
    fields = read_fields(
        [
            {"name": "lang", "transforms": ["trim", "uppercase"], "default": "Other"},
            {"name": "source", "transforms": [
                {"name": "regex_extract", "pattern": r"(?P<nr>\d+)\Z", "group": "nr"},
                {"name": "regex_replace", "pattern": r"^(\d+)$", "replacement": r"Source \g<1>"},
            ]},
            {"name": "body", "transforms": ["collapse_whitespace", "lowercase"]},
            {"name": "second_word", "transforms": [
                "collapse_whitespace", {"name": "regex_extract", "pattern": r"^(\S+) (\S+)", "group": 2}]},
            {"name": "no_dot", "transforms": ["collapse_whitespace", {"name": "strip_suffix", "value": "."}]},
        ]
    )
    done = process_records(docs, fields, ["DE", "es", "n/a"])
    return done.select(
        "doc_id", "lang", "source", F.md5("body").alias("text_md5"), "second_word",
        F.md5("no_dot").alias("no_dot_md5"),
    )


@query(
    "transform_customers",
    """
SELECT c_custkey, concat('No ', CAST(c_custkey AS STRING)) AS name,
  concat(substr(c_mktsegment, 1, 1), lower(substr(c_mktsegment, 2)), '''S-Own 1', substr(c_mktsegment, 1, 1), lower(substr(c_mktsegment, 2))) AS segment,
  CASE WHEN c_mktsegment = 'MACHINERY' THEN 'none given' ELSE c_mktsegment END AS kind
FROM customer
""",
)
def transform_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.table(spark, sf_dir, "customer").select(
        "c_custkey", F.col("c_name").alias("name"),
        F.concat("c_mktsegment", F.lit("'s-own 1"), "c_mktsegment").alias("segment"),
        F.col("c_mktsegment").alias("kind"),
    )
    fields = read_fields(
        [
            {"name": "name", "transforms": [
                {"name": "strip_prefix", "value": "Customer#"},
                {"name": "regex_replace", "pattern": "^0+(?=.)", "replacement": ""},
                {"name": "regex_replace", "pattern": "^", "repl": "No "},
            ]},
            {"name": "segment", "transforms": ["titlecase"]},
            {"name": "kind", "transforms": ["trim", {"name": "default_if_empty", "value": "none given"}]},
        ]
    )
    return process_records(rows, fields, ["machinery"])


@query(
    "transform_warnings",
    """
SELECT 'field_transform' AS category, 'lang' AS field, 'lang: Unknown transform ''shout'' skipped.' AS message, count(*) AS count FROM documents WHERE lang <> 'de'
UNION ALL SELECT 'field_transform', 'source', 'source: Transform ''regex_extract'' failed safely: no such group', count(*) FROM documents WHERE contains(source, '1')
""",
)
def transform_warnings_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = read_fields(
        [
            {"name": "lang", "transforms": ["trim", "shout"]},
            {"name": "source", "transforms": [{"name": "regex_extract", "pattern": "1", "group": 3}]},
        ]
    )
    return transform_warnings(I.texts(spark, sf_dir, "documents"), fields, ["de"])


# -- shaping ------------------------------------------------------------------

_SHAPING = {
    "cleanup_common_fields": True,
    "join_fields": {"contact_emails": " | "},
    "flatten_fields": ["phones"],
    "drop_empty_fields": True,
    "exclude_fields": ["body"],
    "field_order": ["contact_emails", "doc_id"],
}


def _shape_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = I.texts(spark, sf_dir, "documents")
    mixed = text.let(
        text.extract_emails(F.col("text")),
        lambda emails: F.concat(
            F.transform(emails, lambda e: F.concat(F.lit(" MailTo:"), e)), emails, F.array(F.lit(" "))
        ),
    )
    return docs.select(
        "doc_id",
        mixed.alias("contact_emails"),
        F.transform(text.extract_phones(F.col("text")), lambda p: F.concat(F.lit("tel:"), p)).alias("phones"),
        F.concat(F.lit("mailto:"), F.col("source"), F.lit(" ")).alias("owner_email"),
        F.col("text").alias("body"),
        F.when(F.col("lang") == "en", F.lit(" ")).otherwise(F.col("lang")).alias("lang"),
    )


@query(
    "shape_records",
    f"""
WITH d AS (SELECT doc_id, source, lang, {EMAILS.format(c='text')} AS e, {PHONES.format(c='text')} AS p FROM documents)
SELECT nullif(array_to_string({distinct_list('e')}, ' | '), '') AS contact_emails, doc_id,
  array_to_string({distinct_list('p')}, '; ') AS phones, source AS owner_email, CASE WHEN lang <> 'en' THEN lang END AS lang
FROM d
""",
)
def shape_records_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten_lists(shape_records(_shape_input(spark, sf_dir), read_shaping(_SHAPING)))


@query(
    "cleanup_counters",
    f"""
WITH d AS (SELECT {EMAILS.format(c='text')} AS e0, {PHONES.format(c='text')} AS p0 FROM documents),
d1 AS (SELECT {distinct_list('e0')} AS e, {distinct_list('p0')} AS p FROM d)
SELECT 'list_items_dropped' AS action, count(*) AS count FROM d1
UNION ALL SELECT 'duplicate_list_items_removed', CAST(sum(len(e)) AS BIGINT) FROM d1
UNION ALL SELECT 'fields_joined', count(*) FILTER (len(e) > 0) FROM d1
UNION ALL SELECT 'fields_flattened', count(*) FILTER (len(p) = 1) FROM d1
UNION ALL SELECT 'mailto_prefix_removed', CAST(sum(len(e)) AS BIGINT) + count(*) FROM d1
UNION ALL SELECT 'tel_prefix_removed', CAST(sum(len(p)) AS BIGINT) FROM d1
""",
)
def cleanup_counters_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleanup_counters(_shape_input(spark, sf_dir), read_shaping(_SHAPING))


# -- quality --------------------------------------------------------------------

_QUALITY_FIELDS = ["emails", "phones", "lang", "fax"]


def _quality_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = I.texts(spark, sf_dir, "documents")
    return docs.select(
        "doc_id",
        text.extract_emails(F.col("text")).alias("emails"),
        text.extract_phones(F.col("text")).alias("phones"),
        F.when(F.col("lang") == "en", F.lit("")).otherwise(F.col("lang")).alias("lang"),
    )


_QUALITY_SQL = f"""
d AS (SELECT len({EMAILS.format(c='text')}) > 0 AS emails, len({PHONES.format(c='text')}) > 0 AS phones, lang <> 'en' AS lang FROM documents)
"""


@query(
    "quality_metrics",
    f"""
WITH {_QUALITY_SQL},
t AS (SELECT count(*) AS n, count(*) FILTER (emails) AS emails, count(*) FILTER (phones) AS phones, count(*) FILTER (lang) AS lang, CAST(0 AS BIGINT) AS fax FROM d),
u AS (UNPIVOT t ON emails, phones, lang, fax INTO NAME field VALUE filled)
SELECT field, filled, n - filled AS empty, round(filled / n, 3) AS fill_rate, round((n - filled) / n, 3) AS empty_rate FROM u
""",
)
def quality_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.field_coverage(_quality_input(spark, sf_dir), _QUALITY_FIELDS)


@query(
    "quality_summary",
    f"""
WITH {_QUALITY_SQL}
SELECT count(*) AS records_produced, CAST(4 AS BIGINT) AS configured_field_count,
  count(*) FILTER (NOT emails AND NOT phones AND NOT lang) AS records_with_all_configured_fields_empty,
  'doc_id; emails; phones; lang' AS final_output_fields_seen FROM d
""",
)
def quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_summary(_quality_input(spark, sf_dir), _QUALITY_FIELDS)


def _issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = I.table(spark, sf_dir, "events")
    return events.select(
        F.col("event_type").alias("category"),
        F.concat(F.col("event_type"), F.lit(": "), F.col("props")).alias("message"),
    )


@query(
    "diagnostics_topk",
    """
SELECT concat(event_type, ': ', props) AS message, count(*) AS count FROM events
GROUP BY 1 ORDER BY count DESC, message LIMIT 10
""",
)
def diagnostics_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.top_messages(_issues(spark, sf_dir))


@query(
    "diagnostics_counts",
    "SELECT event_type AS category, count(*) AS count FROM events GROUP BY 1",
)
def diagnostics_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.issue_counts(_issues(spark, sf_dir))


@query(
    "clean_csv",
    """
SELECT CAST(c_custkey AS BIGINT) AS c_custkey, lower(c_name) AS name, lower(c_mktsegment) AS segment, CAST(c_nationkey AS BIGINT) AS c_nationkey, CAST(c_acctbal AS DOUBLE) AS c_acctbal FROM customer
""",
)
def clean_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = I.table(spark, sf_dir, "customer")
    path = scratch(customers, "customers")
    write_csv(customers.select("c_custkey", "c_name", "c_mktsegment", "c_nationkey", "c_acctbal"), path)
    result, _ = clean_csv_plan(
        read_csv(spark, path),
        [
            {"module": "core.rename_columns", "options": {"mapping": {"c_name": "name", "c_mktsegment": "segment"}}},
            {"module": "text.normalize_case", "options": {"columns": ["name", "segment"], "case": "lower"}},
        ],
    )
    kinds = {"c_custkey": "bigint", "c_nationkey": "bigint", "c_acctbal": "double"}
    return result.rows.select(*[F.col(c).cast(kinds.get(c, "string")).alias(c) for c in result.rows.columns])


@query(
    "replace_output",
    """
SELECT 'kept' AS state, CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment FROM customer
UNION ALL SELECT 'replaced', CAST(c_custkey AS VARCHAR), upper(c_name), c_mktsegment FROM customer WHERE c_custkey % 2 = 0
""",
)
def replace_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two outputs hold: after a write that fails, and after one that reads its target."""
    customers = I.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    kept, replaced = scratch(customers, "customers"), scratch(customers, "customers")
    for path in (kept, replaced):
        write_csv(customers, path)
    failing = F.when(F.col("c_custkey") % 10 == 7, F.raise_error(F.lit("no name"))).otherwise(F.col("c_name"))
    try:
        write_csv(customers.withColumn("c_name", failing), kept)
    except Exception as error:
        if "no name" not in str(error):
            raise
    even = read_csv(spark, replaced).filter("c_custkey % 2 = 0")
    write_csv(even.withColumn("c_name", F.upper("c_name")), replaced)
    parts = [
        read_csv(spark, path).withColumn("state", F.lit(state))
        for state, path in (("kept", kept), ("replaced", replaced))
    ]
    return parts[0].unionByName(parts[1])
