"""Analytics on a job ledger and its run reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.functions import urls

# Words in error texts, and the service limits.
BLOCKED_WORDS = ["cloudflare", "captcha", "403", "429", "forbidden", "blocked"]
TIMEOUT_WORDS = ["timed out", "timeout"]
CONNECTION_WORDS = [
    "connection", "dns", "name or service not known", "getaddrinfo",
    "failed to establish a new connection",
]
MAX_RUNTIME_SECONDS = 120
MAX_RECORDS = 500
MAX_PAGES = 10
RETENTION_HOURS = 48


def _mentions(c: Column, words: Sequence[str]) -> Column:
    verdict = F.lit(False)
    for word in words:
        verdict = verdict | c.contains(word)
    return verdict


def _count(counts: Column, key: str) -> Column:
    return F.coalesce(F.try_element_at(counts, F.lit(key)), F.lit(0))


def report_failure(
    row_count: Column,
    mode: Column,
    listing_count: Column,
    stop_reasons: Column,
    errors: Column,
    issue_counts: Column,
    max_records_hit: Column,
) -> Column:
    """Why a run produced nothing; null when it produced rows."""
    text = F.lower(F.coalesce(F.array_join(errors, " | "), F.lit("")))
    reasons = F.coalesce(stop_reasons, F.array().cast("array<string>"))
    directory = F.coalesce(mode.isin("directory_list", "directory_detail"), F.lit(False))
    listings = F.coalesce(listing_count, F.lit(0))
    broken = (_count(issue_counts, "page_extraction_failed") > 0) | (
        _count(issue_counts, "detail_field_extraction_failed") > 0
    )
    unreachable = (_count(issue_counts, "detail_page_fetch_failed") > 0) & (listings > 0)
    return (
        F.when(F.coalesce(row_count, F.lit(0)) > 0, F.lit(None).cast("string"))
        .when(F.coalesce(max_records_hit, F.lit(False)), "max_records_reached")
        .when(F.array_contains(reasons, "max_pages_reached"), "max_pages_reached")
        .when(F.array_contains(reasons, "duplicate_next_page_detected"), "pagination_loop_detected")
        .when(F.array_contains(reasons, "no_next_page_found") & directory, "pagination_selector_not_found")
        .when(_mentions(text, BLOCKED_WORDS), "blocked_by_site")
        .when(_mentions(text, TIMEOUT_WORDS), "timeout")
        .when(_mentions(text, CONNECTION_WORDS), "connection_failed")
        .when(broken | unreachable, "extraction_failed")
        .otherwise("no_results_found")
    )


def error_class(message: Column) -> Column:
    """Failure reason of an exception text."""
    text = F.lower(F.coalesce(message, F.lit("")))
    return (
        F.when(_mentions(text, BLOCKED_WORDS), "blocked_by_site")
        .when(_mentions(text, TIMEOUT_WORDS), "timeout")
        .when(_mentions(text, CONNECTION_WORDS), "connection_failed")
        .otherwise("extraction_failed")
    )


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1e6)


def duration_text(start: Column, end: Column) -> Column:
    """``1.234s`` between two timestamps; null if either is missing."""
    return F.when(
        start.isNotNull() & end.isNotNull(),
        F.format_string("%.3fs", F.round(seconds_between(start, end), 3)),
    )


def refresh_status(jobs: DataFrame, now: Column, max_runtime: int = MAX_RUNTIME_SECONDS) -> DataFrame:
    """Fail running jobs that exceeded the allowed run time."""
    late = (F.col("status") == "running") & (
        seconds_between(F.col("started_at"), now) > max_runtime
    )
    late = F.coalesce(late, F.lit(False))
    return jobs.withColumns(
        {
            "status": F.when(late, "failed").otherwise(F.col("status")),
            "failure_reason": F.when(late, "limit_exceeded"),
            "finished_at": F.when(late, now).otherwise(F.col("finished_at")),
        }
    )


def recover_stale(jobs: DataFrame, now: Column) -> DataFrame:
    """Fail jobs that a restart left behind: queued, or running without a worker."""
    queued = F.col("status") == "queued"
    orphan = (F.col("status") == "running") & ~F.coalesce("worker_alive", F.lit(False))
    stale = F.coalesce(queued | orphan, F.lit(False))
    return jobs.withColumns(
        {
            "failure_reason": F.when(stale, F.when(queued, "service_restarted").otherwise("interrupted_run")),
            "status": F.when(stale, "failed").otherwise(F.col("status")),
            "finished_at": F.when(stale, now).otherwise(F.col("finished_at")),
        }
    )


def expired_jobs(jobs: DataFrame, now: Column, retention_hours: float = RETENTION_HOURS) -> DataFrame:
    """Jobs past retention; queued and running jobs never expire."""
    age = seconds_between(F.coalesce("finished_at", "created_at"), now)
    ended = F.col("status").isNull() | ~F.col("status").isin("queued", "running")
    return jobs.filter(ended & (age > retention_hours * 3600))


def job_status(jobs: DataFrame, reports: DataFrame) -> DataFrame:
    """Ledger rows with the progress of their run report.

    ``reports`` is keyed by ``output_dir``, like the ledger. Failed jobs without a
    ``failure_reason`` of their own get the ``failure`` of their report, if there is one.
    """
    none = F.lit(None).cast("string")
    stored = F.col("failure_reason") if "failure_reason" in jobs.columns else none
    derived = F.col("failure") if "failure" in reports.columns else none
    view = reports.select(
        "output_dir",
        F.lit(True).alias("__reported"),
        F.col("pages_visited").alias("__pages_visited"),
        F.col("pages_crawled").alias("__pages_crawled"),
        F.col("row_count").alias("__row_count"),
        F.col("pagination_urls_followed").alias("__followed"),
        F.col("duration").alias("__duration"),
        derived.alias("__failure"),
    )
    joined = jobs.join(view, "output_dir", "left")
    reported = F.col("__reported").isNotNull()
    shown = reported | (F.col("status") != "queued")

    def progress(*names: str) -> Column:
        return F.when(shown, F.coalesce(*names, F.lit(0)))

    return joined.select(
        "job_id",
        "status",
        F.when(F.col("status").isin("queued", "running", "completed"), F.col("status"))
        .otherwise("failed").alias("current_phase"),
        F.coalesce(stored, F.when(F.col("status") == "failed", F.col("__failure"))).alias("failure_reason"),
        progress("__pages_visited", "__pages_crawled").alias("progress_pages_scanned"),
        progress("__row_count").alias("progress_records_extracted"),
        progress("__followed").alias("progress_pagination_pages"),
        F.col("__pages_visited").alias("pages_visited"),
        F.col("__followed").alias("pagination_urls_followed"),
        F.col("__row_count").alias("records_extracted"),
        F.col("__pages_crawled").alias("crawl_pages_scanned"),
        F.when(reported, F.col("__duration"))
        .otherwise(duration_text(F.col("started_at"), F.col("finished_at"))).alias("run_duration"),
    )


def job_stats(jobs: DataFrame, reports: DataFrame) -> DataFrame:
    """Jobs run, jobs completed and records of completed jobs, each job once."""
    ended = jobs.filter(~F.col("status").isin("queued", "running")).dropDuplicates(["job_id"])
    joined = ended.join(reports.select("output_dir", "row_count"), "output_dir", "left")
    completed = F.col("status") == "completed"
    rows = F.greatest(F.coalesce("row_count", F.lit(0)), F.lit(0))
    return joined.agg(
        F.count(F.lit(1)).alias("jobs_run"),
        F.count_if(completed).alias("completed_scrapes"),
        F.coalesce(F.sum(F.when(completed, rows)), F.lit(0)).cast("bigint").alias("records_extracted"),
    )


def clamp_limits(requests: DataFrame, max_pages: int = MAX_PAGES, max_records: int = MAX_RECORDS) -> DataFrame:
    """Requested limits cut down to the service limits; absent ones take the cap."""

    def clamped(name: str, cap: int, zero_is_absent: bool) -> Column:
        asked = F.col(name)
        if zero_is_absent:
            asked = F.when(asked != 0, asked)
        return F.least(F.coalesce(asked, F.lit(cap)), F.lit(cap))

    return requests.withColumns(
        {
            "crawl_max_pages": clamped("crawl_max_pages", max_pages, True),
            "pagination_max_pages": clamped("pagination_max_pages", max_pages, True),
            "max_records": clamped("max_records", max_records, False),
        }
    )


def preset_limits(presets: DataFrame) -> DataFrame:
    """The page limit that applies to a preset: pagination if on, else crawl."""
    return presets.withColumn(
        "max_pages",
        F.when(F.col("pagination_enabled"), F.col("pagination_max_pages")).otherwise(
            F.col("crawl_max_pages")
        ),
    )


def screen_targets(requests: DataFrame, target: str = "target_url") -> DataFrame:
    """Add ``reject_reason``: invalid_target for URLs that must not be visited."""
    return requests.withColumn(
        "reject_reason", F.when(~urls.is_public_target(target), F.lit("invalid_target"))
    )
