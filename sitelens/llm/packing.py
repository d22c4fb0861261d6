"""Best-fit packing under conflicts.

Documents are cut into pieces of at most ``CAPACITY`` words and packed into bins of that
size so that no bin holds two pieces of one source, or two documents of one duplicate
cluster. Bins are kept in order of the room they have left and carry bitmaps of their
sources and clusters; a piece, largest first, goes to the first bin from its own size
on that conflicts with neither bitmap, which is the tightest compatible one, or else
into a new bin.

Pieces are dealt to shards of about ``SHARD_PIECES`` pieces by a hash of their document,
so that a source or cluster of any share is spread evenly, and each shard packs for
itself. A cluster is, unless a column names it, the hash of a text's words in lower case.

Defined results: null, empty and white-space texts give one piece of 0 words that is in
no bin; a null source conflicts with nothing, nor does a null cluster; repeated rows are
packed each on its own. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.llm import tokens
from sitelens.llm.common import store

CAPACITY = 2048
SHARD_PIECES = 8000
# Bins looked at together while searching for the next compatible one.
STEP = 256


def best_fit(sizes: np.ndarray, sources: np.ndarray, clusters: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each piece, for pieces sorted largest first.

    ``sources`` and ``clusters`` are small numbers, -1 for none; each owns one bit.
    """
    count = len(sizes)
    wide = int(sources.max(initial=-1)) // 64 + 1
    deep = int(clusters.max(initial=-1)) // 64 + 1
    has_source = np.zeros((max(1, wide), count), np.uint64)
    has_cluster = np.zeros((max(1, deep), count), np.uint64)
    room = np.zeros(count, np.int64)  # of the bins in order, and which bins they are
    order = np.zeros(count, np.int64)
    out = np.zeros(count, np.int64)
    bins = 0
    for piece, (size, source, cluster) in enumerate(
        zip(sizes.tolist(), sources.tolist(), clusters.tolist(), strict=True)
    ):
        at = int(np.searchsorted(room[:bins], size))
        place = -1
        while at < bins and place < 0:
            near = order[at : min(at + STEP, bins)]
            clash = np.zeros(len(near), bool)
            if source >= 0:
                clash |= (has_source[source // 64, near] >> np.uint64(source % 64)) & np.uint64(1) > 0
            if cluster >= 0:
                clash |= (has_cluster[cluster // 64, near] >> np.uint64(cluster % 64)) & np.uint64(1) > 0
            free = int(np.argmin(clash))
            if not clash[free]:
                place = at + free
            at += STEP
        if place < 0:
            here, left = bins, capacity - size
            bins += 1
            place = bins - 1
        else:
            here, left = int(order[place]), int(room[place]) - size
        to = int(np.searchsorted(room[:place], left))  # rooms only shrink: move down
        room[to + 1 : place + 1] = room[to:place].copy()
        order[to + 1 : place + 1] = order[to:place].copy()
        room[to], order[to] = left, here
        if source >= 0:
            has_source[source // 64, here] |= np.uint64(1 << (source % 64))
        if cluster >= 0:
            has_cluster[cluster // 64, here] |= np.uint64(1 << (cluster % 64))
        out[piece] = here
    return out


def pieces(
    docs: DataFrame, doc_id: str, text: str, source: str, cluster: str | None, capacity: int
) -> DataFrame:
    """doc, source, cluster, piece, start_word, n_words of every piece."""
    named = F.col(cluster).cast("string") if cluster else F.lit(None).cast("string")
    rows = docs.select(
        F.col(doc_id).alias("doc"),
        F.col(source).cast("string").alias("source"),
        named.alias("cluster"),
        F.col(text).alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.blocks(batch, "text"):
                found = tokens.words(*tokens.utf8(part.column("text")), "space")
                n = np.diff(found.first)
                clusters = part.column("cluster")
                if cluster is None:
                    whole = tokens.sequences(found.hashes, found.first[:-1], found.first[1:])
                    clusters = pa.array([str(x) if k else None for x, k in zip(whole, n, strict=True)],
                                        pa.string())
                many = np.maximum(1, -(-n // capacity))
                row = np.repeat(np.arange(len(n)), many)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                start = piece * capacity
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc").take(take), part.column("source").take(take),
                     clusters.take(take), pa.array(piece.astype(np.int32)), pa.array(start),
                     pa.array(np.minimum(capacity, n[row] - start))],
                    ["doc", "source", "cluster", "piece", "start_word", "n_words"],
                )

    kind = rows.schema["doc"].dataType.simpleString()
    return rows.mapInArrow(
        run,
        f"doc {kind}, source string, cluster string, piece int, start_word long, n_words long",
    )


def pack(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    cluster: str | None = None,
    capacity: int = CAPACITY,
    shard_pieces: int = SHARD_PIECES,
) -> DataFrame:
    """doc_id, piece, start_word, n_words, shard, bin and bin_room of every piece.

    Texts are read once and not shuffled, only the narrow rows of pieces are.
    """
    found = store(pieces(docs, doc_id, text, source, cluster, capacity))
    shards = max(1, -(-found.count() // shard_pieces))
    dealt = found.withColumn(
        "shard", F.pmod(F.xxhash64("doc", "piece", "cluster"), F.lit(shards)).cast("int")
    )
    kind = found.schema["doc"].dataType.simpleString()

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(
            ["n_words", "doc", "piece", "cluster", "source"],
            ascending=[False, True, True, True, True],
            ignore_index=True,
        )
        # Only clusters that occur twice in the shard can clash.
        again = frame["cluster"].where(frame["cluster"].duplicated(keep=False))
        sizes = frame["n_words"].to_numpy()
        used = best_fit(
            sizes[sizes > 0],
            pd.factorize(frame["source"])[0][sizes > 0],
            pd.factorize(again)[0][sizes > 0],
            capacity,
        )
        bins = np.full(len(frame), -1)
        bins[sizes > 0] = used
        room = capacity - np.bincount(used, sizes[sizes > 0], len(frame)).astype(np.int64)
        frame["bin"] = pd.array(bins, "Int64").copy()
        frame["bin_room"] = pd.array(room[bins], "Int64").copy()
        frame.loc[sizes == 0, ["bin", "bin_room"]] = pd.NA
        frame[doc_id] = frame["doc"]
        return frame[names]

    names = [doc_id, "piece", "start_word", "n_words", "shard", "bin", "bin_room"]
    return dealt.groupBy("shard").applyInPandas(
        run,
        f"{doc_id} {kind}, piece int, start_word long, n_words long, shard int, "
        "bin long, bin_room long",
    )
