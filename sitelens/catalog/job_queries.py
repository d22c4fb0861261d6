"""Queries on the job ledger, the throttle, and the streaming variants."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.catalog import inputs as I
from sitelens.catalog.registry import Registry, flatten_lists, scratch
from sitelens.catalog.sql import EMAILS, distinct_list, tidy
from sitelens.operators import jobs as J
from sitelens.operators.limits import limits_report
from sitelens.operators.quality import field_coverage, quality_summary
from sitelens.operators.throttle import throttle
from sitelens.plans.result import Result
from sitelens.plans.spec import read_fields
from sitelens.sources.ledger import read_reports, scan_jobs
from sitelens.sources.sinks import write_report
from sitelens.streaming.jobs import extract_stream, stats_stream, throttle_stream

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle

_JOBS = I.as_sql(I.JOBS)
_REPORTS = I.as_sql(I.REPORTS)
NOW = "2024-01-20 12:00:00"


def _now():
    return F.lit(NOW).cast("timestamp")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.derive(spark, sf_dir, I.JOBS)


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.derive(spark, sf_dir, I.REPORTS)


_FAILURE = """CASE WHEN row_count > 0 THEN NULL WHEN max_records_hit THEN 'max_records_reached'
  WHEN stop_reason = 'max_pages_reached' THEN 'max_pages_reached'
  WHEN stop_reason = 'duplicate_next_page_detected' THEN 'pagination_loop_detected'
  WHEN stop_reason = 'no_next_page_found' AND mode <> 'site_scan' THEN 'pagination_selector_not_found'
  WHEN error_text = 'GET: 403 Forbidden' THEN 'blocked_by_site' WHEN error_text = 'Read TIMED OUT' THEN 'timeout'
  WHEN error_text = 'DNS failure' THEN 'connection_failed'
  WHEN issue = 'page_extraction_failed' OR (issue = 'detail_page_fetch_failed' AND listing_count > 0) THEN 'extraction_failed'
  ELSE 'no_results_found' END"""


def failure() -> Column:
    return J.report_failure(
        F.col("row_count"), F.col("mode"), F.col("listing_count"), F.array("stop_reason"),
        F.array(F.lit("first"), F.col("error_text")), F.create_map("issue", F.lit(2)),
        F.col("max_records_hit"),
    )


@query(
    "job_status",
    f"""
SELECT j.job_id, j.status, CASE WHEN j.status IN ('queued', 'running', 'completed') THEN j.status ELSE 'failed' END AS current_phase,
  CASE WHEN r.output_dir IS NOT NULL OR j.status <> 'queued' THEN coalesce(r.pages_visited, r.pages_crawled, 0) END AS progress_pages_scanned,
  CASE WHEN r.output_dir IS NOT NULL OR j.status <> 'queued' THEN coalesce(r.row_count, 0) END AS progress_records_extracted,
  CASE WHEN r.output_dir IS NOT NULL OR j.status <> 'queued' THEN coalesce(r.pagination_urls_followed, 0) END AS progress_pagination_pages,
  r.pages_visited, r.pagination_urls_followed, r.row_count AS records_extracted, r.pages_crawled AS crawl_pages_scanned,
  r.duration AS run_duration,
  CASE WHEN j.status = 'failed' THEN CASE WHEN j.event_id % 5 = 0 THEN 'limit_exceeded' ELSE r.failure END END AS failure_reason
FROM ({_JOBS}) j LEFT JOIN (SELECT *, {_FAILURE} AS failure FROM ({_REPORTS}) x) r ON r.output_dir = j.output_dir
""",
)
def job_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    noted = F.when((F.col("status") == "failed") & (F.col("event_id") % 5 == 0), "limit_exceeded")
    return J.job_status(
        jobs(spark, sf_dir).withColumn("failure_reason", noted),
        reports(spark, sf_dir).withColumn("failure", failure()),
    )


@query(
    "job_durations",
    f"""
SELECT job_id, CASE WHEN finished_at IS NOT NULL AND started_at IS NOT NULL
  THEN printf('%.3fs', epoch(finished_at) - epoch(started_at)) END AS run_duration FROM ({_JOBS}) j
""",
)
def job_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs(spark, sf_dir).select(
        "job_id", J.duration_text(F.col("started_at"), F.col("finished_at")).alias("run_duration")
    )


@query(
    "job_stats",
    f"""
SELECT count(*) AS jobs_run, count(*) FILTER (j.status = 'completed') AS completed_scrapes,
  CAST(coalesce(sum(greatest(coalesce(r.row_count, 0), 0)) FILTER (j.status = 'completed'), 0) AS BIGINT) AS records_extracted
FROM ({_JOBS}) j LEFT JOIN ({_REPORTS}) r ON r.output_dir = j.output_dir WHERE j.status NOT IN ('queued', 'running')
""",
)
def job_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.job_stats(jobs(spark, sf_dir), reports(spark, sf_dir))


@query(
    "job_failures",
    f"""
SELECT output_dir, {_FAILURE} AS reason
FROM ({_REPORTS}) r
""",
)
def job_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports(spark, sf_dir).select("output_dir", failure().alias("reason"))


@query(
    "error_classes",
    f"""
SELECT output_dir, CASE WHEN error_text = 'GET: 403 Forbidden' THEN 'blocked_by_site' WHEN error_text = 'Read TIMED OUT' THEN 'timeout'
  WHEN error_text = 'DNS failure' THEN 'connection_failed' ELSE 'extraction_failed' END AS reason FROM ({_REPORTS}) r
""",
)
def error_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports(spark, sf_dir).select("output_dir", J.error_class(F.col("error_text")).alias("reason"))


@query(
    "job_runtime",
    f"""
SELECT job_id, CASE WHEN status = 'running' AND epoch(TIMESTAMP '{NOW}') - epoch(started_at) > 86400 THEN 'failed' ELSE status END AS status,
  CASE WHEN status = 'running' AND epoch(TIMESTAMP '{NOW}') - epoch(started_at) > 86400 THEN 'limit_exceeded' END AS failure_reason
FROM ({_JOBS}) j
""",
)
def job_runtime(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = J.refresh_status(jobs(spark, sf_dir), _now(), 86400)
    return checked.select("job_id", "status", "failure_reason")


@query(
    "job_stale",
    f"""
SELECT job_id, CASE WHEN status = 'queued' OR (status = 'running' AND NOT worker_alive) THEN 'failed' ELSE status END AS status,
  CASE WHEN status = 'queued' THEN 'service_restarted' WHEN status = 'running' AND NOT worker_alive THEN 'interrupted_run' END AS failure_reason,
  CASE WHEN status = 'queued' OR (status = 'running' AND NOT worker_alive) THEN '{NOW}' ELSE strftime(finished_at, '%Y-%m-%d %H:%M:%S') END AS finished_at
FROM ({_JOBS}) j
""",
)
def job_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = J.recover_stale(jobs(spark, sf_dir), _now())
    return found.select(
        "job_id", "status", "failure_reason",
        F.date_format("finished_at", "yyyy-MM-dd HH:mm:ss").alias("finished_at"),
    )


@query(
    "job_expired",
    f"""
SELECT job_id FROM ({_JOBS}) j WHERE status NOT IN ('queued', 'running')
  AND epoch(TIMESTAMP '{NOW}') - epoch(coalesce(finished_at, created_at)) > 48 * 3600
""",
)
def job_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.expired_jobs(jobs(spark, sf_dir), _now()).select("job_id")


_REQUESTS = """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 0 WHEN 1 THEN NULL ELSE user_id % 30 END AS crawl_max_pages,
  user_id % 25 AS pagination_max_pages, CASE WHEN event_id % 3 = 0 THEN NULL ELSE user_id * 10 END AS max_records,
  event_type = 'click' AS pagination_enabled
FROM {events}
"""


@query(
    "job_limits",
    f"""
WITH q AS ({I.as_sql(_REQUESTS)}),
c AS (
  SELECT event_id, least(coalesce(nullif(crawl_max_pages, 0), 10), 10) AS crawl_max_pages, least(coalesce(nullif(pagination_max_pages, 0), 10), 10) AS pagination_max_pages,
    least(coalesce(max_records, 500), 500) AS max_records, pagination_enabled FROM q)
SELECT event_id, crawl_max_pages, pagination_max_pages, max_records, CASE WHEN pagination_enabled THEN pagination_max_pages ELSE crawl_max_pages END AS max_pages FROM c
""",
)
def job_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    clamped = J.clamp_limits(I.derive(spark, sf_dir, _REQUESTS))
    return J.preset_limits(clamped).drop("pagination_enabled")


_SUBMITTED = """
SELECT event_id, CASE event_type
    WHEN 'click' THEN concat('http://', CAST(event_id % 256 AS STRING), '.', CAST(user_id % 256 AS STRING), '.', CAST(event_id % 7 AS STRING), '.9/x')
    WHEN 'view' THEN concat('https://site', CAST(user_id AS STRING), '.org/')
    WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'ftp://example.com' ELSE 'localhost/x' END
    WHEN 'signup' THEN CASE WHEN event_id % 2 = 0 THEN '' ELSE 'http://[fe80::1]/' END
    ELSE CASE WHEN event_id % 2 = 0 THEN 'Example.com/a' ELSE 'http://[2606:4700::1]/' END END AS target_url,
  event_id % 256 AS o1, user_id % 256 AS o2, event_id % 7 AS o3, event_type
FROM {events}
"""


@query(
    "safe_targets",
    f"""
WITH s AS ({I.as_sql(_SUBMITTED)})
SELECT event_id, CASE
  WHEN event_type = 'click' AND (o1 IN (0, 10, 127) OR o1 >= 240 OR (o1 = 100 AND o2 BETWEEN 64 AND 127) OR (o1 = 169 AND o2 = 254)
    OR (o1 = 172 AND o2 BETWEEN 16 AND 31) OR (o1 = 192 AND o2 = 0 AND o3 = 2) OR (o1 = 192 AND o2 = 168)
    OR (o1 = 198 AND o2 IN (18, 19))) THEN 'invalid_target'
  WHEN event_type = 'error' THEN 'invalid_target' WHEN event_type = 'signup' THEN 'invalid_target' END AS reject_reason
FROM s
""",
)
def safe_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.screen_targets(I.derive(spark, sf_dir, _SUBMITTED, I.texts)).select("event_id", "reject_reason")


# -- ledger and report files ----------------------------------------------------------

# The last event of every user as a job entry; some files are broken or no entry.
_ENTRIES = """
SELECT user_id, event_id, event_type, ts FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM {events}) e WHERE n = 1
"""


@query(
    "ledger_scan",
    f"""
SELECT user_id, CASE WHEN user_id % 11 = 5 OR user_id % 13 = 4 THEN NULL WHEN user_id % 17 = 3 THEN NULL ELSE CAST(event_id AS VARCHAR) END AS job_id,
  CASE WHEN user_id % 11 = 5 OR user_id % 13 = 4 THEN NULL ELSE event_type END AS status,
  CASE WHEN user_id % 11 = 5 OR user_id % 13 = 4 THEN NULL ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS finished_at,
  CASE WHEN user_id % 11 = 5 OR user_id % 13 = 4 THEN NULL ELSE concat('/out dir/', CAST(user_id AS VARCHAR)) END AS output_dir,
  CASE WHEN user_id % 11 = 5 OR user_id % 13 = 4 THEN 'not a JSON object' WHEN user_id % 17 = 3 THEN 'no job_id' END AS problem
FROM ({I.as_sql(_ENTRIES)}) e
""",
)
def ledger_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file per user, written and scanned; what is no entry is a row of its own."""
    entries = I.derive(spark, sf_dir, _ENTRIES)
    root = scratch(entries, "ledger")
    entry = F.to_json(
        F.struct(
            F.when(F.col("user_id") % 17 != 3, F.col("event_id").cast("string")).alias("job_id"),
            F.col("event_type").alias("status"),
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'").alias("finished_at"),
            F.concat(F.lit("file:/out dir/"), F.col("user_id").cast("string"), F.lit("/")).alias("output_dir"),
            F.lit("yes").alias("worker_alive"),
        )
    )
    text = (
        F.when(F.col("user_id") % 11 == 5, F.concat(F.substring(entry, 1, 20), F.lit("\n")))
        .when(F.col("user_id") % 13 == 4, F.concat(F.lit("["), entry, F.lit("]")))
        .otherwise(entry)
    )
    # Many small files: a fixed number of tasks, as their bytes say nothing of the work, and
    # each moves its own files to the folder instead of the driver doing it for all. (By the
    # user alone the rows lie so already, and Spark would leave this out and join the tasks.)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = entries.select(
        F.col("user_id").alias("user"), F.lit("job.json").alias("file"), text.alias("value")
    ).repartition(tasks, F.xxhash64("user"))
    at_once = files.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2")
    at_once.partitionBy("user", "file").text(root)
    found = scan_jobs(spark, root, "user=*/file=job.json")
    return found.select(
        F.regexp_extract("path", r"/user=(\d+)/", 1).cast("bigint").alias("user_id"),
        "job_id",
        "status",
        F.date_format("finished_at", "yyyy-MM-dd HH:mm:ss").alias("finished_at"),
        "output_dir",
        "problem",
    )


_MODES = ["site_scan", "directory_list", "directory_detail"]
_STOP = "CASE WHEN user_id % 3 = 0 THEN 'max_pages_reached' ELSE 'no_next_page_found' END"


@query(
    "report_round_trip",
    f"""
WITH e AS (SELECT *, event_id % 3 AS k, concat(event_type, ': ', props) AS message FROM events),
t AS (SELECT k, user_id, count(*) AS n FROM e GROUP BY 1, 2),
runs AS (
  SELECT k, count(*) AS row_count, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'signup') AS signups,
    round(count(*) FILTER (event_type <> 'view') / count(*), 3) AS fill_rate FROM e GROUP BY 1),
top AS (
  SELECT k, message, count(*) AS n, row_number() OVER (PARTITION BY k ORDER BY count(*) DESC, message) AS place
  FROM e WHERE event_type IN ('error', 'signup') GROUP BY 1, 2)
SELECT CAST(r.k AS VARCHAR) AS job_id, ['site_scan', 'directory_list', 'directory_detail'][r.k + 1] AS mode, 'completed' AS status,
  r.row_count AS records_extracted, (SELECT CAST(sum(n) AS BIGINT) FROM t WHERE t.k = r.k) AS crawl_pages_scanned,
  (SELECT count(*) FROM t WHERE t.k = r.k) AS target_count, r.errors AS error_count, r.signups AS signup_limits,
  top.message AS top_message, top.n AS top_count, r.fill_rate, '65.250s' AS run_duration,
  'max_pages_reached; no_next_page_found' AS stop_reasons, false AS max_records_hit
FROM runs r JOIN top ON top.k = r.k AND top.place = 1
""",
)
def report_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of three runs, written by one writer, read by the other, joined to their jobs."""
    events = I.table(spark, sf_dir, "events")
    root = scratch(events, "reports")
    started = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    for k, mode in enumerate(_MODES):
        rows = events.filter(F.col("event_id") % 3 == k).select(
            F.when(F.col("event_type") != "view", F.col("event_type")).alias("kind"),
            "event_type",
            "user_id",
            F.concat(F.col("event_type"), F.lit(": "), F.col("props")).alias("message"),
        )
        targets = rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("pages_crawled"))
        category = F.when(F.col("event_type") == "error", "page_fetch_failed").otherwise("max_records_reached")
        result = Result(
            fields=["kind"],
            mode=mode,
            rows=rows,
            targets=targets.withColumn("stop_reason", F.expr(_STOP)),
            issues=rows.filter(F.col("event_type").isin("error", "signup")).select(category.alias("category"), "message"),
            coverage=field_coverage(rows, ["kind"]),
            summary=quality_summary(rows, ["kind"]),
            limits=limits_report(spark.createDataFrame([], "cap_noticed boolean, cut_records bigint"), 500),
        )
        ended = started + datetime.timedelta(seconds=65.25)
        write_report(result, f"{root}/{k}/report", run_name=mode, started_at=started, ended_at=ended)
    reports = read_reports(spark, root)
    jobs = reports.select(
        F.regexp_extract("output_dir", "([^/]+)$", 1).alias("job_id"),
        F.lit("completed").alias("status"),
        "output_dir",
        F.lit(None).cast("timestamp").alias("started_at"),
        F.lit(None).cast("timestamp").alias("finished_at"),
    )
    more = reports.select(
        F.regexp_extract("output_dir", "([^/]+)$", 1).alias("job_id"),
        "mode",
        "target_count",
        "error_count",
        F.col("diagnostics.non_fatal_issue_counts")["max_records_reached"].alias("signup_limits"),
        F.col("diagnostics.non_fatal_issue_messages")[0].message.alias("top_message"),
        F.col("diagnostics.non_fatal_issue_messages")[0]["count"].alias("top_count"),
        F.col("quality_metrics.configured_field_coverage")["kind"].fill_rate.alias("fill_rate"),
        F.array_join("pagination_stopped_reasons", "; ").alias("stop_reasons"),
        F.col("limits.max_records_hit").alias("max_records_hit"),
    )
    status = J.job_status(jobs, reports).select(
        "job_id", "status", "records_extracted", "crawl_pages_scanned", "run_duration"
    )
    return status.join(more, "job_id")


# -- throttle -----------------------------------------------------------------------

_N, _WINDOW = 2, 24 * 3600
_THROTTLE = f"""
WITH RECURSIVE s AS (
  SELECT submission_id, coalesce(client_ip, 'unknown') AS client, epoch_us(ts) AS t,
    row_number() OVER (PARTITION BY coalesce(client_ip, 'unknown') ORDER BY ts, submission_id) AS n FROM ({I.as_sql(I.SUBMISSIONS)}) q),
w AS (
  SELECT client, n, submission_id, true AS accepted, [t] AS taken FROM s WHERE n = 1
  UNION ALL
  SELECT client, n, submission_id, len(live) < {_N}, CASE WHEN len(live) < {_N} THEN list_append(live, t) ELSE live END FROM (
    SELECT s.client, s.n, s.submission_id, s.t, list_filter(w.taken, lambda x: x >= s.t - {_WINDOW}::BIGINT * 1000000) AS live
    FROM w JOIN s ON s.client = w.client AND s.n = w.n + 1) x)
SELECT submission_id, accepted FROM w
"""


@query("throttle_batch", _THROTTLE)
def throttle_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    submitted = I.derive(spark, sf_dir, I.SUBMISSIONS)
    return throttle(submitted, _N, _WINDOW).select("submission_id", "accepted")


@query("throttle_long_runs", _THROTTLE)
def throttle_long_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same verdicts with every busy run treated as too long for one task."""
    submitted = I.derive(spark, sf_dir, I.SUBMISSIONS)
    return throttle(submitted, _N, _WINDOW, run_rows=0).select("submission_id", "accepted")


# -- streams ------------------------------------------------------------------------


def _drain(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over what is there now and read its output table."""
    path = scratch(stream, name)
    started = (
        stream.writeStream.format("parquet")
        .option("path", f"{path}/out")
        .option("checkpointLocation", f"{path}/state")
        .trigger(availableNow=True)
        .start()
    )
    started.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files, whether it is one file or a folder of them."""
    schema = I.table(spark, sf_dir, name).schema
    # A stream reads a single file only where its path is a pattern.
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


@query(
    "pages_stream",
    f"""
WITH p AS (SELECT page_id, {tidy("regexp_extract(html, '<title>([^<]*)</title>', 1)")} AS title, {EMAILS.format(c='html')} AS e FROM pages)
SELECT page_id, nullif(title, '') AS page_title, array_to_string({distinct_list('e')}, '; ') AS emails FROM p
""",
)
def pages_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = read_fields(
        [{"name": "page_title", "type": "page_title"}, {"name": "emails", "type": "emails", "many": True}]
    )
    found = extract_stream(_stream(spark, sf_dir, "pages"), fields, ["page_id"])
    return _drain(flatten_lists(found.select("page_id", "page_title", "emails")), "pages")


@query(
    "stats_stream",
    """
SELECT count(*) AS jobs_run, count(*) FILTER (event_type IN ('purchase', 'signup')) AS completed_scrapes,
  CAST(sum(greatest(CAST(floor(value) AS BIGINT) - 5, 0)) FILTER (event_type IN ('purchase', 'signup')) AS BIGINT) AS records_extracted
FROM events WHERE event_type NOT IN ('view', 'click')
""",
)
def stats_stream_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _stream(spark, sf_dir, "events")
    # Every event comes twice; each job counts once.
    twice = F.explode(F.array(F.lit(0), F.lit(1)))
    finished = events.select(
        F.col("event_id").cast("string").alias("job_id"),
        F.col("ts").cast("timestamp").alias("finished_at"),
        twice.alias("again"),
        F.when(F.col("event_type").isin("purchase", "signup"), "completed")
        .when(F.col("event_type") == "view", "queued")
        .when(F.col("event_type") == "click", "running")
        .otherwise("failed")
        .alias("status"),
        (F.floor("value") - 5).alias("row_count"),
    )
    totals = stats_stream(finished, "60 days")
    path = scratch(totals, "stats")
    # Running totals are one row per batch; every batch replaces the last.
    started = (
        totals.writeStream.outputMode("complete")
        .option("checkpointLocation", f"{path}/state")
        .trigger(availableNow=True)
        .foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{path}/out"))
        .start()
    )
    started.awaitTermination()
    return spark.read.schema(totals.schema).parquet(f"{path}/out")


# Files that the throttle stream reads one by one, and how late an event may be in them.
_SLICE, _LATE = 10 * 86400, 43200


def _arriving(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Events as files of ten days each, where an event may lie up to half a day late, and
    at last a row without an event that only carries a later time."""
    moment = F.unix_seconds(F.col("ts").cast("timestamp"))
    events = I.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("submission_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("user_id") % 20 == 3, F.lit(None)).otherwise(F.col("user_id").cast("string")).alias("client_ip"),
        F.floor((moment + F.pmod(F.xxhash64("event_id"), F.lit(_LATE))) / _SLICE).alias("slice"),
    )
    bounds = events.agg(F.min("slice"), F.max("slice"), F.max("ts")).first()
    if bounds[0] is None:
        events.drop("slice").write.parquet(path)
        return
    for k in range(bounds[0], bounds[1] + 1):
        events.filter(F.col("slice") == k).drop("slice").coalesce(1).write.mode("append").parquet(path)
    later = F.lit(bounds[2]) + F.make_dt_interval(F.lit(60))
    clock = spark.range(1).select(
        F.lit(None).cast("bigint").alias("submission_id"), later.alias("ts"), F.lit(None).cast("string").alias("client_ip")
    )
    clock.write.mode("append").parquet(path)


@query("throttle_stream", _THROTTLE)
def throttle_stream_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in several micro-batches, not in order of time."""
    path = scratch(I.table(spark, sf_dir, "events"), "submitted")
    _arriving(spark, sf_dir, path)
    schema = "submission_id bigint, ts timestamp, client_ip string"
    submitted = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    verdicts = throttle_stream(submitted, _N, _WINDOW, f"{_LATE} seconds")
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(
        provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    )
    try:
        return _drain(verdicts.select("submission_id", "accepted"), "throttle")
    finally:
        spark.conf.set(provider, before)
