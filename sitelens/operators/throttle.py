"""Submission throttle: accept while fewer than N were accepted in the window.

Whether a submission is accepted depends on the accepted ones before it, so this
is a sequential rule per client, but only within the trailing window. Time is cut
into cells as long as the window; an event can only be affected by its own and
the previous cell. Consecutive used cells of a client form a run, and runs are
independent of each other:

* calm runs, where no two neighbouring cells hold more than N events, are
  accepted as they are;
* short runs are scanned in order with a state of at most N times, many runs per
  task;
* long runs (a client that never pauses) go stretch by stretch, all runs at once. A
  stretch is as many consecutive cells as one task may scan, and hands on its last N
  accepted times; so the number of rounds follows the events, not the cells. A cell
  with more events than that is a stretch of its own: it frees at most N places at
  known times, so only the first N events after each of them can be accepted; that is
  a top-N per group, which is cut down before the shuffle. No task ever sees a whole
  long run.
"""

from __future__ import annotations

import uuid
from collections import deque
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitelens.operators.skew import checkpoint_dir, cut_lineage, salted_join

RUN_ROWS = 1_000_000
MAX_BROADCAST_RUNS = 100_000


def runs_of(events: DataFrame, n: int, run_rows: int = RUN_ROWS) -> DataFrame:
    """(client, cell) -> run, stretch, large, run_rows, calm.

    The window runs over cells, not events: their number per client is the time
    span over the window length, however many submissions there are.
    """
    cells = events.groupBy("__client", "__cell").agg(F.count(F.lit(1)).alias("n"))
    by_time = W.partitionBy("__client").orderBy("__cell")
    before = F.lag("__cell").over(by_time)
    adjacent = F.coalesce(before == F.col("__cell") - 1, F.lit(False))
    marked = cells.withColumns(
        {
            "starts": (~adjacent).cast("int"),
            "pair": F.col("n") + F.when(adjacent, F.lag("n").over(by_time)).otherwise(0),
        }
    )
    numbered = marked.withColumn("__run", F.sum("starts").over(by_time))
    in_run = W.partitionBy("__client", "__run")
    along = in_run.orderBy("__cell")
    earlier = F.coalesce(F.sum("n").over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    large = F.col("n") > run_rows
    measured = numbered.withColumns(
        {"__large": large, "__load": F.floor(earlier / F.lit(max(run_rows, 1)))}
    )
    opens = (
        F.col("__large")
        | F.coalesce(F.lag("__large").over(along), F.lit(True))
        | (F.lag("__load").over(along) != F.col("__load"))
    )
    return measured.withColumn("__opens", opens.cast("int")).select(
        "__client",
        "__cell",
        "__run",
        F.sum("__opens").over(along).cast("int").alias("__stretch"),
        "__large",
        F.sum("n").over(in_run).alias("__run_rows"),
        (F.max("pair").over(in_run) <= n).alias("__calm"),
    )


def _scan_short_runs(events: DataFrame, n: int, window_us: int) -> DataFrame:
    """Ordered scan of whole runs inside hash partitions, O(N) state."""
    columns = ["__client", "__run", "__t", "__id"]
    ordered = events.select(*columns).repartition("__client", "__run").sortWithinPartitions(*columns)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, taken = None, deque()
        for batch in batches:
            clients, runs, times = (batch.column(i).to_pylist() for i in range(3))
            accepted = []
            for client, run, t in zip(clients, runs, times):
                if (client, run) != current:
                    current = (client, run)
                    taken.clear()
                while taken and taken[0] < t - window_us:
                    taken.popleft()
                ok = len(taken) < n
                if ok:
                    taken.append(t)
                accepted.append(ok)
            yield pa.RecordBatch.from_arrays(
                [batch.column(3), pa.array(accepted, pa.bool_())], ["__id", "accepted"]
            )

    id_type = ordered.schema["__id"].dataType.simpleString()
    return ordered.mapInArrow(scan, f"__id {id_type}, accepted boolean")


def _step_long_runs(events: DataFrame, state: DataFrame, n: int, window_us: int) -> DataFrame:
    """Accepted events of one cell per run, given those of the previous cell."""
    placed = events.join(state, ["__client", "__run"]).withColumn(
        "segment", F.size(F.filter("taken", lambda s: s + window_us < F.col("__t")))
    )
    first = W.partitionBy("__client", "__run", "segment").orderBy("__t", "__id")
    # At most N per segment and N + 1 segments, so what is gathered is bounded.
    candidates = placed.withColumn("rn", F.row_number().over(first)).filter(F.col("rn") <= n)
    gathered = candidates.groupBy("__client", "__run").agg(
        F.array_sort(F.collect_list(F.struct("__t", "__id"))).alias("c"),
        F.first("taken").alias("taken"),
    )
    id_type = events.schema["__id"].dataType.simpleString()
    chosen = F.aggregate(
        "c",
        F.array().cast(f"array<struct<__t:bigint,__id:{id_type}>>"),
        lambda acc, e: F.when(
            F.size(acc) + F.size(F.filter("taken", lambda s: s + window_us >= e["__t"])) < n,
            F.array_append(acc, e),
        ).otherwise(acc),
    )
    return gathered.select("__client", "__run", chosen.alias("chosen"))


def _scan_stretches(events: DataFrame, state: DataFrame, n: int, window_us: int) -> DataFrame:
    """Accepted events of one stretch per run, scanned in order from the state before it."""
    columns = ["__client", "__run", "__t", "__id"]
    placed = events.join(state, ["__client", "__run"]).select(*columns, "taken")
    ordered = placed.repartition("__client", "__run").sortWithinPartitions(*columns)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, taken = None, deque()
        for batch in batches:
            clients, runs, times = (batch.column(i).to_pylist() for i in range(3))
            accepted = []
            for i, (client, run, t) in enumerate(zip(clients, runs, times)):
                if (client, run) != current:
                    current = (client, run)
                    taken = deque(sorted(batch.column(4)[i].as_py()))
                while taken and taken[0] < t - window_us:
                    taken.popleft()
                if len(taken) < n:
                    taken.append(t)
                    accepted.append(i)
            yield batch.select([0, 1, 2, 3]).take(pa.array(accepted, pa.int64()))

    id_type = ordered.schema["__id"].dataType.simpleString()
    return ordered.mapInArrow(scan, f"__client string, __run bigint, __t bigint, __id {id_type}")


def _walk_long_runs(events: DataFrame, n: int, window_us: int) -> DataFrame | None:
    """Ids accepted in long runs, or None when there are none."""
    folder = f"{checkpoint_dir(events)}/throttle-{uuid.uuid4().hex}"
    spark = events.sparkSession
    id_type = events.schema["__id"].dataType.simpleString()
    # One folder per step, so a step reads its own stretches only.
    events.select("__client", "__run", "__stretch", "__large", "__t", "__id").repartition(
        "__stretch", F.pmod(F.xxhash64("__id"), F.lit(16))
    ).write.partitionBy("__stretch").parquet(folder)
    schema = f"__client string, __run bigint, __large boolean, __t bigint, __id {id_type}, __stretch int"
    table = spark.read.schema(schema).parquet(folder)
    last, any_large, all_large = table.agg(
        F.max("__stretch"), F.bool_or("__large"), F.bool_and("__large")
    ).first()
    if last is None:
        return None
    nothing = F.array().cast("array<bigint>")
    runs = cut_lineage(table.filter("__stretch = 1").select("__client", "__run").distinct())
    # Every long run holds over RUN_ROWS events, so runs are few; checked anyway.
    few = runs.count() <= MAX_BROADCAST_RUNS
    state = runs.withColumn("taken", nothing)
    accepted = None
    latest = W.partitionBy("__client", "__run").orderBy(F.desc("__t"), F.desc("__id"))
    for stretch in range(1, last + 1):
        here = table.filter(F.col("__stretch") == stretch)
        lookup = F.broadcast(state) if few else state
        parts = []
        if any_large:
            chosen = _step_long_runs(here.filter("__large"), lookup, n, window_us)
            parts.append(chosen.select("__client", "__run", F.inline("chosen")))
        if not all_large:
            parts.append(_scan_stretches(here.filter("not __large"), lookup, n, window_us))
        step = cut_lineage(reduce(DataFrame.unionByName, parts))
        ids = step.select("__id")
        accepted = ids if accepted is None else accepted.unionByName(ids)
        # A stretch lasts a window at least: what was taken before it is free after it.
        kept = step.withColumn("__n", F.row_number().over(latest)).filter(F.col("__n") <= n)
        taken = kept.groupBy("__client", "__run").agg(F.sort_array(F.collect_list("__t")).alias("taken"))
        state = runs.join(taken, ["__client", "__run"], "left").withColumn("taken", F.coalesce("taken", nothing))
    return accepted


def throttle(
    submissions: DataFrame,
    n: int,
    window_s: int,
    client: str = "client_ip",
    ts: str = "ts",
    order: str = "submission_id",
    run_rows: int = RUN_ROWS,
) -> DataFrame:
    """Add ``accepted``: fewer than ``n`` accepted in the last ``window_s`` seconds.

    The window is inclusive, rejected submissions do not count, and a missing
    client counts as ``unknown``. ``order`` is a unique column that breaks ties.
    """
    if n <= 0:
        return submissions.withColumn("accepted", F.lit(False))
    window_us = int(window_s) * 1_000_000
    keyed = submissions.select(
        F.col(order).alias("__id"),
        F.coalesce(F.when(F.col(client).cast("string") != "", F.col(client).cast("string")), F.lit("unknown")).alias("__client"),
        F.unix_micros(ts).alias("__t"),
    ).withColumn("__cell", F.floor(F.col("__t") / F.lit(window_us)).cast("bigint"))
    known = keyed.count()
    assigned = cut_lineage(
        salted_join(keyed, runs_of(keyed, n, run_rows), ["__client", "__cell"], known_rows=known)
    )
    busy = assigned.filter(~F.col("__calm"))
    calm = assigned.filter("__calm").select("__id", F.lit(True).alias("accepted"))
    short = _scan_short_runs(busy.filter(F.col("__run_rows") <= run_rows), n, window_us)
    verdicts = calm.unionByName(short)
    long_rows = busy.filter(F.col("__run_rows") > run_rows)
    if not long_rows.isEmpty():
        accepted = _walk_long_runs(long_rows, n, window_us)
        verdicts = verdicts.unionByName(accepted.withColumn("accepted", F.lit(True)))
    # Submissions of long runs without a verdict were rejected.
    return (
        submissions.join(verdicts.withColumnRenamed("__id", order), order, "left")
        .withColumn("accepted", F.coalesce("accepted", F.lit(False)))
    )
