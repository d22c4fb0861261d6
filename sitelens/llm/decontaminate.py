"""Benchmark decontamination by greedy string tiling.

Words are runs of letters and digits (case and punctuation do not count). Documents
and benchmark items meet in seeds: Karp-Rabin hashes of ``min_tile`` consecutive
words. For every pair that shares enough seeds, the longest match of unmarked words
is marked again and again until none of ``min_tile`` words is left; a pair is
contaminated when the marked words are at least ``coverage`` of the item. Order does
not matter, so an item whose sentences were moved around is still caught.

Defined results: a null or empty text, and an item of fewer than ``min_tile`` words,
matches nothing; rows that repeat a document or an item count once; rows with one id
and different texts are compared on their own and reported under the id. Only the
named columns are read, whatever else the tables hold.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.llm import tokens
from sitelens.llm.common import bitmap, bits_for, in_bitmap, store

MIN_TILE = 5
COVERAGE = 0.6


def tile(places: list[tuple[int, int]], width: int) -> list[tuple[int, int, int]]:
    """Tiles (item position, document position, words) of greedy string tiling.

    ``places`` are the pairs of positions at which windows of ``width`` words agree.
    Longest first, ties by position; what is already marked is cut off a match, and
    the rest is tried again if it still has ``width`` words.
    """
    heap: list[tuple[int, int, int]] = []
    seen = set(places)
    for p, q in seen:
        if (p - 1, q - 1) not in seen:
            n = 1
            while (p + n, q + n) in seen:
                n += 1
            heap.append((-(n + width - 1), p, q))
    heapq.heapify(heap)
    item_marked: set[int] = set()
    doc_marked: set[int] = set()
    tiles = []
    while heap:
        size, p, q = heapq.heappop(heap)
        free = [i for i in range(-size) if p + i not in item_marked and q + i not in doc_marked]
        if len(free) == -size:
            item_marked.update(range(p, p - size))
            doc_marked.update(range(q, q - size))
            tiles.append((p, q, -size))
            continue
        start = previous = None
        for i in [*free, None]:
            if start is not None and i != previous + 1:
                if previous - start + 1 >= width:
                    heapq.heappush(heap, (start - previous - 1, p + start, q + start))
                start = None
            if start is None:
                start = i
            previous = i
    return tiles


def _item_seeds(items: DataFrame, item_id: str, text: str, width: int) -> DataFrame:
    """item, words of the item, and its seeds in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.blocks(batch, "text"):
                found = tokens.words(*tokens.utf8(part.column("text")), "alnum")
                every = tokens.windows(found.hashes, width).view(np.int64)
                spans = list(zip(found.first[:-1], found.first[1:], strict=True))
                seeds = [every[a : max(a, b - width + 1)] for a, b in spans]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("item"),
                        part.column("item_row"),
                        pa.array([int(b - a) for a, b in spans], pa.int32()),
                        tokens.lists(seeds, pa.int64()),
                    ],
                    ["item", "item_row", "words", "seeds"],
                )

    rows = items.select(
        F.col(item_id).alias("item"), F.xxhash64(text).alias("item_row"), F.col(text).alias("text")
    ).dropDuplicates(["item", "item_row"])
    kind = rows.schema["item"].dataType.simpleString()
    return rows.mapInArrow(run, f"item {kind}, item_row long, words int, seeds array<long>")


def _doc_seeds(docs: DataFrame, doc_id: str, text: str, width: int, wanted) -> DataFrame:
    """Seeds of each document that some item may have, with their positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        for batch in batches:
            for part in tokens.blocks(batch, "text"):
                found = tokens.words(*tokens.utf8(part.column("text")), "alnum")
                every = tokens.windows(found.hashes, width).view(np.int64)
                at = np.flatnonzero(in_bitmap(bits, every))
                row = np.searchsorted(found.first, at, "right") - 1
                inside = at + width <= found.first[row + 1]
                at, row = at[inside], row[inside]
                if len(at):
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("doc").take(pa.array(row)),
                            part.column("doc_row").take(pa.array(row)),
                            pa.array(every[at]),
                            pa.array((at - found.first[row]).astype(np.int32)),
                        ],
                        ["doc", "doc_row", "seed", "pos"],
                    )

    rows = docs.select(
        F.col(doc_id).alias("doc"), F.xxhash64(text).alias("doc_row"), F.col(text).alias("text")
    )
    kind = rows.schema["doc"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc {kind}, doc_row long, seed long, pos int")


def contaminated_pairs(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text: str = "text",
    min_tile: int = MIN_TILE,
    coverage: float = COVERAGE,
) -> DataFrame:
    """One row per contaminated (document, item) with its tiles.

    The documents are read once and never shuffled: a bitmap of the items' seeds, of
    fixed size, lets through only seeds that an item may have. Seeds join on their
    hash; a passage that leaked into many documents is a hot key of that join only,
    where one side has a row per item and adaptive execution splits the other.
    """
    sequences = store(_item_seeds(items, item_id, text, min_tile))
    seeds = sequences.select("item", "item_row", F.explode(F.array_distinct("seeds")).alias("seed"))
    wanted = docs.sparkSession.sparkContext.broadcast(bitmap(seeds, "seed", bits_for(seeds)))
    hits = _doc_seeds(docs, doc_id, text, min_tile, wanted).join(seeds, "seed")
    keys = ["doc", "doc_row", "item", "item_row"]
    pairs = (
        hits.groupBy(*keys)
        .agg(
            F.collect_set(F.struct("seed", "pos")).alias("hits"),
            F.collect_set("seed").alias("found"),
        )
        .join(sequences, ["item", "item_row"])
        # Each place of the item with a seed that was found covers at most its words.
        .filter(
            F.size(F.filter("seeds", lambda s: F.array_contains("found", s))) * min_tile
            >= F.col("words") * coverage
        )
        .drop("found")
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                at: dict[int, list[int]] = {}
                for hit in row.hits:
                    at.setdefault(hit["seed"], []).append(hit["pos"])
                places = [(p, q) for p, s in enumerate(row.seeds) for q in at.get(s, ())]
                tiles = sorted(tile(places, min_tile), key=lambda t: t[1])
                covered = sum(t[2] for t in tiles)
                if covered >= coverage * row.words:
                    starts, sizes = [t[1] for t in tiles], [t[2] for t in tiles]
                    out.append((row.doc, row.item, row.words, covered, covered / row.words,
                                max(sizes), starts, sizes))
            yield pd.DataFrame(out, columns=names)

    names = [doc_id, item_id, "item_words", "covered_words", "coverage", "longest_tile",
             "tile_starts", "tile_words"]
    kinds = [pairs.schema[c].dataType.simpleString() for c in ("doc", "item")]
    schema = (
        f"{doc_id} {kinds[0]}, {item_id} {kinds[1]}, item_words int, covered_words int, "
        "coverage double, longest_tile int, tile_starts array<int>, tile_words array<int>"
    )
    return pairs.mapInPandas(run, schema)


def decontaminate(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", **settings
) -> DataFrame:
    """The documents that contain no benchmark item, with their columns."""
    bad = contaminated_pairs(docs, items, doc_id, **settings).select(F.col(doc_id).alias("__bad"))
    return docs.join(bad.distinct(), F.col(doc_id).eqNullSafe(F.col("__bad")), "left_anti")
