"""Streams of pages, finished jobs and submissions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sitelens.operators.extract import extract_fields
from sitelens.plans.spec import FieldSpec


def extract_stream(pages: DataFrame, fields: Sequence[FieldSpec], keep: Sequence[str]) -> DataFrame:
    """Field extraction is stateless, so the batch operator serves streams as it is."""
    return extract_fields(pages, fields, keep)


def stats_stream(jobs: DataFrame, delay: str = "2 days") -> DataFrame:
    """Running totals of finished jobs, each job once; write with output mode ``complete``.

    ``jobs`` has job_id, status, row_count and finished_at. Events of jobs that are queued
    or running do not count. The first event of a job counts; repeats that come while the
    watermark is less than ``delay`` past it change nothing, and the state forgets it then.
    """
    ended = jobs.filter(~F.col("status").isin("queued", "running"))
    once = ended.withWatermark("finished_at", delay).dropDuplicatesWithinWatermark(["job_id"])
    completed = F.col("status") == "completed"
    rows = F.greatest(F.coalesce("row_count", F.lit(0)), F.lit(0))
    return once.groupBy().agg(
        F.count(F.lit(1)).alias("jobs_run"),
        F.count_if(completed).alias("completed_scrapes"),
        F.coalesce(F.sum(F.when(completed, rows)), F.lit(0)).cast("bigint").alias("records_extracted"),
    )


class _Throttle(StatefulProcessor):
    """Judges the submissions of one client in the order of their times.

    ``waiting`` holds those that the watermark has not passed: earlier ones may still
    come. A timer wakes the client when it has passed the first of them. ``taken`` holds
    the accepted times that later submissions can still see, at most ``n``; a timer
    clears them when the last has left the window, and nothing is left of the client.
    """

    def __init__(self, n: int, window_us: int) -> None:
        self.n, self.window_us = n, window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "t bigint, submission_id bigint")
        self.taken = handle.getListState("taken", "t bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrived = [
            (int(t), int(i))
            for batch in rows
            for t, i, real in zip(batch["t"], batch["submission_id"], batch["real"], strict=True)
            if real
        ]
        if arrived:
            self.waiting.appendList(arrived)
            self._wake(min(arrived)[0])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted((t, i) for t, i in self.waiting.get())
        taken = sorted(t for (t,) in self.taken.get())
        judged = [w for w in waiting if w[0] < passed]
        accepted = []
        for t, _ in judged:
            taken = [x for x in taken if x >= t - self.window_us]
            ok = len(taken) < self.n
            if ok:
                taken.append(t)
            accepted.append(ok)
        left = waiting[len(judged) :]
        taken = [x for x in taken if x >= passed - self.window_us]
        for state, values in ((self.waiting, left), (self.taken, [(t,) for t in taken])):
            if values:
                state.put(values)
            else:
                state.clear()
        if left:
            self._wake(left[0][0])
        elif taken:
            self._wake(taken[-1] + self.window_us)
        if judged:
            yield pd.DataFrame(
                {"submission_id": [i for _, i in judged], "client_ip": key[0], "accepted": accepted}
            )

    def _wake(self, t: int) -> None:
        """Call again when the watermark is past a time."""
        self.handle.registerTimer(t // 1000 + 1)

    def close(self) -> None:
        pass


def throttle_stream(submissions: DataFrame, n: int, window_s: int, delay: str = "10 minutes") -> DataFrame:
    """Verdict per submission (submission_id, client_ip, accepted), in event time.

    Submissions may come in any order and in any micro-batch as long as none is more than
    ``delay`` behind the latest; verdicts are those of the batch operator. A verdict
    comes out when the watermark has passed its submission. What comes later than that
    has no verdict, and neither has a submission without a time. Rows without a
    submission_id only move time on: a source that pauses can send them to get its last
    verdicts. State of a client lasts until its window has passed.

    Needs the RocksDB state store provider.
    """
    keyed = submissions.filter(F.col("ts").isNotNull()).withWatermark("ts", delay).select(
        F.coalesce(F.when(F.col("client_ip") != "", F.col("client_ip")), F.lit("unknown")).alias("client_ip"),
        F.coalesce(F.col("submission_id").cast("bigint"), F.lit(0)).alias("submission_id"),
        F.col("submission_id").isNotNull().alias("real"),
        F.unix_micros("ts").alias("t"),
        "ts",
    )
    # A filter on real rows would be moved before the watermark, and time would stand still.
    return keyed.groupBy("client_ip").transformWithStateInPandas(
        statefulProcessor=_Throttle(n, int(window_s) * 1_000_000),
        outputStructType="submission_id bigint, client_ip string, accepted boolean",
        outputMode="append",
        timeMode="EventTime",
    )
