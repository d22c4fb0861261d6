"""Exact deduplication by exchanging Golomb-coded fingerprints.

Every partition sends the sorted fingerprints of its texts to their owners, as Rice
coded gaps (Golomb codes whose parameter is a power of two). An owner answers each
message with a bitmap of those fingerprints that occur more than once. Rows whose
bit is set are suspects; only suspects' texts are shuffled, to be compared byte by
byte.

Defined results: a null text counts as empty; repeated rows are members like others;
of equal texts the row with the largest id stays, and when that id itself repeats,
``kept`` is true for each of its rows (``distinct_rows`` drops the repeats). A null
id stays only where all ids of the group are null. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.llm.common import bitmap, bits_for, in_bitmap, store


def rice_encode(values: np.ndarray) -> bytes:
    """Sorted uint64 values as Rice-coded gaps: count, parameter, unary part, remainders."""
    n = len(values)
    if not n:
        return b""
    gaps = np.diff(values, prepend=np.uint64(0))
    mean = int(values[-1]) // n
    k = min(56, max(0, mean.bit_length() - 1))
    high = (gaps >> np.uint64(k)).astype(np.int64)
    unary = np.zeros(int(high.sum()) + n, np.uint8)
    unary[np.cumsum(high + 1) - 1] = 1
    places = np.arange(k, dtype=np.uint64)
    low = ((gaps[:, None] >> places) & np.uint64(1)).astype(np.uint8)
    head = np.array([n, k, len(unary)], np.int64).tobytes()
    return head + np.packbits(unary).tobytes() + np.packbits(low.ravel()).tobytes()


def rice_decode(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, np.uint64)
    n, k, bits = (int(x) for x in np.frombuffer(blob, np.int64, 3))
    raw = np.frombuffer(blob, np.uint8, offset=24)
    used = (bits + 7) // 8
    ones = np.flatnonzero(np.unpackbits(raw[:used], count=bits))
    high = np.diff(ones, prepend=-1) - 1
    low = np.unpackbits(raw[used:], count=n * k).reshape(n, k).astype(np.uint64)
    gaps = high.astype(np.uint64) << np.uint64(k)
    for i in range(k):
        gaps |= low[:, i] << np.uint64(i)
    return np.cumsum(gaps, dtype=np.uint64)


def _messages(prints: DataFrame, owners: int) -> DataFrame:
    """(owner, part, blob, repeated): the distinct fingerprints of a part, by owner."""
    step = (1 << 64) // owners + 1
    bounds = np.array([owner * step for owner in range(owners)], np.uint64)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for part, rows in frame.groupby("part"):
                found, times = np.unique(rows["fp"].to_numpy().view(np.uint64), return_counts=True)
                cuts = [*np.searchsorted(found, bounds), len(found)]
                for owner in np.flatnonzero(np.diff(cuts)):
                    mine = slice(cuts[owner], cuts[owner + 1])
                    often = np.packbits(times[mine] > 1).tobytes()
                    out.append((owner, part, rice_encode(found[mine] - bounds[owner]), often))
            yield pd.DataFrame(out, columns=["owner", "part", "blob", "often"])

    return prints.select("part", "fp").mapInPandas(
        run, "owner int, part long, blob binary, often binary"
    )


def _answers(messages: DataFrame) -> DataFrame:
    """(part, owner, blob, twice): a bit per fingerprint sent, set if it occurs again."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        sets = [rice_decode(b) for b in frame["blob"]]
        often = [
            np.unpackbits(np.frombuffer(o, np.uint8), count=len(s)).astype(bool)
            for s, o in zip(sets, frame["often"], strict=True)
        ]
        every = np.sort(np.concatenate(sets))
        again = np.unique(
            np.concatenate([every[1:][every[1:] == every[:-1]],
                            *[s[o] for s, o in zip(sets, often, strict=True)]])
        )
        twice = [np.packbits(np.isin(s, again)).tobytes() for s in sets]
        return pd.DataFrame(
            {"part": frame["part"], "owner": frame["owner"], "blob": frame["blob"], "twice": twice}
        )

    return messages.groupBy("owner").applyInPandas(
        run, "part long, owner int, blob binary, twice binary"
    )


def _suspects(answers: DataFrame, owners: int) -> DataFrame:
    """The fingerprints that the answers mark; a part gets each of its own once."""
    step = (1 << 64) // owners + 1

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for owner, blob, twice in zip(
                frame["owner"], frame["blob"], frame["twice"], strict=True
            ):
                found = rice_decode(blob) + np.uint64(owner * step)
                marked = np.unpackbits(np.frombuffer(twice, np.uint8), count=len(found)) == 1
                yield pd.DataFrame({"fp": found[marked].view(np.int64)})

    return answers.mapInPandas(run, "fp long")


def text_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept and text_sha256.

    A fingerprint is sent once per partition however many rows have it, and equal
    texts are counted on the map side before the shuffle, so a hot text reaches no
    task more than once per partition.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(doc_id).alias("id"), F.xxhash64(body).alias("fp"), body.alias("body")
    )
    prints = store(
        rows.select(
            "id",
            "fp",
            F.unhex(F.sha2("body", 256)).alias("sha"),
            F.spark_partition_id().cast("long").alias("part"),
        )
    )
    owners = int(spark.conf.get("spark.sql.shuffle.partitions"))
    suspects = _suspects(_answers(_messages(prints, owners)), owners)
    marked = spark.sparkContext.broadcast(bitmap(suspects, "fp", bits_for(prints)))

    def may_repeat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(marked.value, batch.column("fp").to_numpy())))

    # A row that the bitmap lets through by chance is a group of one.
    groups = (
        rows.mapInArrow(may_repeat, rows.schema)
        .groupBy("body")
        .agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .filter("group_size > 1")
        .select(F.unhex(F.sha2("body", 256)).alias("sha"), "keep_id", "group_size")
    )
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return (
        prints.select("id", "sha")
        .join(groups, "sha", "left")
        .select(
            F.col("id").alias("doc_id"),
            keep.alias("keep_id"),
            F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
            keep.eqNullSafe(F.col("id")).alias("kept"),
            F.lower(F.hex("sha")).alias("text_sha256"),
        )
    )


def distinct_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, one row per text, with their columns."""
    groups = store(text_groups(docs, doc_id, text))
    sha = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    on = F.col(doc_id).eqNullSafe(F.col("__id")) & sha.eqNullSafe(F.col("__sha"))
    names = [F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha")]
    out = docs.join(groups.filter(~F.col("kept")).select(*names).distinct(), on, "left_anti")
    # Rows with the id and the text of a kept row repeat it; one of them stays.
    twins = groups.filter("kept").groupBy(*names).count().filter("count > 1").drop("count")
    if twins.isEmpty():
        return out
    several = out.join(twins, on, "left_semi").withColumn("__own", sha)
    return out.join(twins, on, "left_anti").unionByName(
        several.dropDuplicates([doc_id, "__own"]).drop("__own")
    )
