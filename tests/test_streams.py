"""Streams in event time: shuffled input over many micro-batches gives the batch results."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from sitelens.operators import jobs as J
from sitelens.operators.throttle import throttle
from sitelens.streaming.jobs import stats_stream, throttle_stream

BASE = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
SUBMISSION = "submission_id bigint, client_ip string, ts timestamp"
JOB = "job_id string, status string, row_count bigint, finished_at timestamp"


def at(seconds):
    return None if seconds is None else BASE + datetime.timedelta(seconds=seconds)


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(key, before)


def source(spark, path, ddl, *batches):
    """A stream that gets one batch of rows per micro-batch."""
    for rows in batches:
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(path)


def run(stream, path, mode="append"):
    """Rows put out, and the number of rows of state that are left."""
    out = {}
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True)

    def keep(df, number):
        out[number] = [tuple(r) for r in df.collect()]

    query = writer.foreachBatch(keep).start()
    query.awaitTermination()
    last = [s["numRowsTotal"] for s in query.lastProgress["stateOperators"]]
    return out, last


def greedy(events, n, window):
    taken, verdicts = {}, {}
    for i, client, t in sorted(events, key=lambda e: (e[2], e[0])):
        live = [x for x in taken.get(client or "unknown", []) if x >= t - window]
        verdicts[i] = len(live) < n
        taken[client or "unknown"] = live + [t] if verdicts[i] else live
    return verdicts


def test_shuffled_submissions_get_the_batch_verdicts(spark, tmp_path, rocksdb):
    draw = random.Random(9)
    events = [(i, draw.choice(["a", "a", "b", None, ""]), draw.randrange(0, 4000)) for i in range(300)]
    # A submission may come up to 400 seconds after a later one.
    arriving = sorted(events, key=lambda e: e[2] + draw.randrange(0, 400))
    parts = [arriving[k : k + 60] for k in range(0, 300, 60)]
    batches = [[(i, c, at(t)) for i, c, t in part] for part in parts]
    time_passes = [(None, "clock", at(100_000))]
    stream = source(spark, str(tmp_path / "in"), SUBMISSION, *batches, time_passes)
    out, left = run(throttle_stream(stream, 3, 250, "400 seconds"), str(tmp_path))
    got = {i: ok for rows in out.values() for i, _, ok in rows}
    want = greedy(events, 3, 250)
    assert got == want and sum(map(len, out.values())) == 300
    df = spark.createDataFrame([(i, c, at(t)) for i, c, t in events], SUBMISSION)
    assert {r.submission_id: r.accepted for r in throttle(df, 3, 250).collect()} == want
    assert sum(bool(rows) for rows in out.values()) >= 3  # verdicts come while the stream runs
    # Order by arrival would have judged otherwise.
    by_arrival, taken = {}, {}
    for i, c, t in arriving:
        live = [x for x in taken.get(c or "unknown", []) if x >= t - 250]
        by_arrival[i] = len(live) < 3
        taken[c or "unknown"] = live + [t] if by_arrival[i] else live
    assert by_arrival != want
    assert left == [0]  # nothing is kept of clients whose window has passed


def test_no_verdicts_for_late_and_timeless_submissions(spark, tmp_path, rocksdb):
    batches = [
        [(1, "a", at(1000)), (2, "a", None)],
        [(3, "b", at(5000))],
        [(4, "a", at(100)), (5, "a", at(5000))],
        [(None, None, at(50_000))],
    ]
    stream = source(spark, str(tmp_path / "in"), SUBMISSION, *batches)
    out, left = run(throttle_stream(stream, 1, 60, "10 seconds"), str(tmp_path))
    assert {i: ok for rows in out.values() for i, _, ok in rows} == {1: True, 3: True, 5: True}
    assert left == [0]


def test_each_job_counts_once(spark, tmp_path):
    draw = random.Random(4)
    jobs = [(str(i), draw.choice(["completed", "failed", "running", "queued"]), draw.randint(-3, 9), at(i * 10)) for i in range(90)]
    batches = [jobs[k : k + 30] + draw.sample(jobs[max(0, k - 30) : k + 30], 25) for k in (0, 30, 60)]
    stream = source(spark, str(tmp_path / "in"), JOB, *batches)
    out, _ = run(stats_stream(stream, "1 hour"), str(tmp_path), "complete")
    table = spark.createDataFrame(jobs, JOB)
    reports = table.select(F.col("job_id").alias("output_dir"), "row_count")
    want = J.job_stats(table.withColumn("output_dir", F.col("job_id")).drop("row_count"), reports).first()
    assert out[max(out)] == [tuple(want)]


def test_forgotten_jobs_leave_the_state(spark, tmp_path):
    first = [(str(i), "completed", 1, at(i)) for i in range(50)]
    stream = source(spark, str(tmp_path / "in"), JOB, first, [("x", "completed", 1, at(10_000))], [("y", "failed", 1, at(10_001))])
    out, left = run(stats_stream(stream, "60 seconds"), str(tmp_path), "complete")
    assert out[max(out)] == [(52, 51, 51)]
    assert min(left) <= 3  # the duplicates' state; the totals are one row
