"""The report of a run: one nested record made from the tables of its result.

Counts become maps, by aggregates; what can be as long as the run (targets, single
issues, warnings per field) stays in tables of its own beside the record. In the record
``errors`` holds the first message of each kind that failure rules tell apart, so it is
short whatever the run, and classifies like the whole list.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.operators.jobs import BLOCKED_WORDS, CONNECTION_WORDS, TIMEOUT_WORDS
from sitelens.operators.quality import stop_reason_counts, top_messages
from sitelens.plans.result import Result

# Counters of targets that a run adds up; a mode that lacks one reports 0.
COUNTERS = [
    "pages_crawled", "pages_succeeded", "pages_failed", "pages_visited", "listing_count",
    "detail_pages_attempted", "detail_pages_successful", "detail_pages_failed",
    "pagination_urls_followed",
]
# Issues that tell of a limit, not of an error.
NOT_ERRORS = ["max_records_reached", "detail_page_limit_skipped", "max_detail_pages_reached"]
_MESSAGE = "array<struct<message:string,count:bigint>>"
REPORT_DDL = (
    "run_name string, config_name string, mode string, started_at timestamp, ended_at timestamp, "
    "duration_seconds double, duration string, target_count bigint, row_count bigint, error_count bigint, "
    + "".join(f"{name} bigint, " for name in COUNTERS)
    + "pagination_stopped_reasons array<string>, extracted_field_names array<string>, errors array<string>, "
    f"diagnostics struct<warning_total:bigint, warning_counts_by_category:map<string,bigint>, "
    f"warning_counts_by_field:map<string,bigint>, warning_messages:{_MESSAGE}, "
    f"cleanup_actions:map<string,bigint>, non_fatal_issue_counts:map<string,bigint>, "
    f"non_fatal_issue_messages:{_MESSAGE}, pagination_stop_reason_counts:map<string,bigint>>, "
    "limits struct<max_records:bigint, max_detail_pages:bigint, max_records_hit:boolean, "
    "max_detail_pages_hit:boolean, records_truncated:bigint, detail_pages_skipped_due_to_limit:bigint>, "
    "quality_metrics struct<records_produced:bigint, configured_field_count:bigint, "
    "configured_fields:array<string>, final_output_fields_seen:array<string>, "
    "records_with_all_configured_fields_empty:bigint, "
    "configured_field_coverage:map<string,struct<filled:bigint,empty:bigint,fill_rate:double,empty_rate:double>>>"
)


def _as_map(counts: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """One row: a map of few keys (categories, configured fields, actions), in key order."""
    entries = F.sort_array(F.collect_list(F.struct(F.col(key).alias("k"), F.col(value).alias("v"))))
    return counts.agg(F.map_from_entries(entries).alias(name))


def _messages(counted: DataFrame, name: str) -> DataFrame:
    """One row: at most ten (message, count), the most frequent first."""
    at = F.struct(F.negative("count").alias("minus"), F.col("message"))
    listed = F.transform(
        F.sort_array(F.collect_list(at)),
        lambda x: F.struct(x.message.alias("message"), F.negative(x.minus).alias("count")),
    )
    return counted.agg(listed.alias(name))


def _error_kind(message: Column) -> Column:
    lowered = F.lower(message)

    def mentions(words: list[str]) -> Column:
        return reduce(lambda a, b: a | b, [lowered.contains(w) for w in words])

    return (
        F.when(mentions(BLOCKED_WORDS), 1).when(mentions(TIMEOUT_WORDS), 2)
        .when(mentions(CONNECTION_WORDS), 3).otherwise(4)
    )


def run_report(result: Result, **about) -> DataFrame:
    """The record of a run as a DataFrame of one row with the columns of ``REPORT_DDL``.

    ``about`` gives run_name, config_name, started_at and ended_at (datetimes); what is
    left out is null. Tables that the result lacks count as empty.
    """
    spark = result.rows.sparkSession
    pieces: list[DataFrame] = []
    parts: dict[str, Column] = {}

    def put(piece: DataFrame) -> None:
        pieces.append(piece)

    summary = result.summary
    if summary is None:
        put(result.rows.agg(F.count(F.lit(1)).alias("records_produced")))
        seen, all_empty = F.lit("; ".join(result.rows.columns)), F.lit(None)
    else:
        put(summary)
        seen, all_empty = F.col("final_output_fields_seen"), F.col("records_with_all_configured_fields_empty")
    if result.coverage is not None:
        rates = F.struct("filled", "empty", "fill_rate", "empty_rate")
        put(_as_map(result.coverage.withColumn("__v", rates), "field", "__v", "coverage"))
        parts["coverage"] = F.col("coverage")
    targets = result.targets
    if targets is not None:
        have = [c for c in COUNTERS if c in targets.columns]
        put(targets.agg(F.count(F.lit(1)).alias("target_count"), *[F.sum(c).alias(c) for c in have]))
        parts |= {c: F.col(c) for c in ["target_count", *have]}
        if "stop_reason" in targets.columns:
            put(_as_map(stop_reason_counts(targets), "stop_reason", "count", "stop_reasons"))
            parts["stop_reasons"] = F.col("stop_reasons")
    if result.issues is not None:
        issues = result.issues
        put(_as_map(issues.groupBy("category").agg(F.count(F.lit(1)).alias("n")), "category", "n", "issue_counts"))
        put(_messages(top_messages(issues), "issue_messages"))
        errors = issues.filter(~F.col("category").isin(NOT_ERRORS))
        kinds = errors.groupBy(_error_kind(F.col("message")).alias("kind")).agg(
            F.min("message").alias("message"), F.count(F.lit(1)).alias("n")
        )
        first = F.transform(F.sort_array(F.collect_list(F.struct("kind", "message"))), lambda x: x.message)
        put(kinds.agg(first.alias("errors"), F.sum("n").alias("error_count")))
        parts |= {c: F.col(c) for c in ("issue_counts", "issue_messages", "errors", "error_count")}
    if result.warnings is not None:
        warnings = result.warnings
        for key, name in (("category", "by_category"), ("field", "by_field")):
            put(_as_map(warnings.groupBy(key).agg(F.sum("count").alias("n")), key, "n", name))
        top = warnings.groupBy("message").agg(F.sum("count").alias("count"))
        put(_messages(top.orderBy(F.desc("count"), "message").limit(10), "warning_messages"))
        put(warnings.agg(F.sum("count").alias("warning_total")))
        parts |= {c: F.col(c) for c in ("by_category", "by_field", "warning_messages", "warning_total")}
    if result.cleanup is not None:
        used = result.cleanup.filter("count > 0")
        put(_as_map(used, "action", "count", "cleanup_actions"))
        parts["cleanup_actions"] = F.col("cleanup_actions")
    if result.limits is not None:
        limits = result.limits
        put(limits.select(F.struct(*limits.columns).alias("limits")))
        parts["limits"] = F.col("limits")

    one = pieces[0].withColumn("__one", F.lit(1))
    for piece in pieces[1:]:  # each has one row
        one = one.join(F.broadcast(piece.withColumn("__one", F.lit(1))), "__one")
    return one.select(*_columns(spark, result, about, parts, seen, all_empty))


def _columns(
    spark: SparkSession, result: Result, about: Mapping, parts: Mapping[str, Column], seen: Column, all_empty: Column
) -> list[Column]:
    schema = spark.createDataFrame([], REPORT_DDL).schema
    started, ended = about.get("started_at"), about.get("ended_at")
    seconds = round((ended - started).total_seconds(), 3) if started and ended else None
    none = F.lit(None)
    number = F.lit(0)
    names = F.array(*[F.lit(n) for n in result.fields])
    reasons = parts.get("stop_reasons")
    limits = parts.get("limits")
    found: dict[str, Column] = {
        "run_name": F.lit(about.get("run_name")),
        "config_name": F.lit(about.get("config_name")),
        "mode": F.lit(result.mode),
        "started_at": F.lit(started),
        "ended_at": F.lit(ended),
        "duration_seconds": F.lit(seconds),
        "duration": F.lit(None if seconds is None else f"{seconds:.3f}s"),
        "row_count": F.col("records_produced"),
        **{c: F.coalesce(parts.get(c, number), number) for c in ("target_count", "error_count", *COUNTERS)},
        "pagination_stopped_reasons": F.map_keys(reasons) if reasons is not None else F.array(),
        "extracted_field_names": names,
        "errors": parts.get("errors", F.array()),
        "diagnostics": F.struct(
            F.coalesce(parts.get("warning_total", number), number).alias("warning_total"),
            parts.get("by_category", F.create_map()).alias("warning_counts_by_category"),
            parts.get("by_field", F.create_map()).alias("warning_counts_by_field"),
            parts.get("warning_messages", F.array()).cast(_MESSAGE).alias("warning_messages"),
            parts.get("cleanup_actions", F.create_map()).alias("cleanup_actions"),
            parts.get("issue_counts", F.create_map()).alias("non_fatal_issue_counts"),
            parts.get("issue_messages", F.array()).cast(_MESSAGE).alias("non_fatal_issue_messages"),
            (reasons if reasons is not None else F.create_map()).alias("pagination_stop_reason_counts"),
        ),
        "limits": F.struct(
            *[
                (limits[f.name] if limits is not None else none).cast(f.dataType).alias(f.name)
                for f in schema["limits"].dataType.fields
            ]
        ),
        "quality_metrics": F.struct(
            F.col("records_produced"),
            F.lit(len(result.fields)).alias("configured_field_count"),
            names.alias("configured_fields"),
            F.split(seen, "; ", -1).alias("final_output_fields_seen"),
            all_empty.alias("records_with_all_configured_fields_empty"),
            parts.get("coverage", F.create_map()).alias("configured_field_coverage"),
        ),
    }
    return [found[f.name].cast(f.dataType).alias(f.name) for f in schema.fields]
