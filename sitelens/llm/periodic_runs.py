"""Periodic runs: stretches of words that repeat themselves, found by internal matching.

A run is a stretch of words with a smallest period q (words q apart are equal), at least
2q words and ``least`` words long, that no word beside it extends. The words of many
documents are searched at once, with a mark of its own after each document:

* Prefix doubling names all stretches of 1, 2, 4, ... words, so that equal names mean
  equal words, and sorts the suffixes; the places of a name are a range of that order.
* A run with period q, 2b - 1 <= q <= 4b - 2, holds a dyadic block of b words that occurs
  again q words later. A block asks for its next places in the window that begins 2b - 1
  words after it: the smallest value above a bound in a range of the suffix array, which a
  wavelet tree answers. Places nearer than half a block are one progression, whose end
  follows from how far its first two members agree; multiples of the block's own period
  are skipped, as no smallest period is one.
* How far the words agree before and behind a block and its candidate is read off the
  names, from long to short. That gives the run; equal stretches keep the least period.

Everything is exact: no hash of words is trusted, and every run is found.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.llm.tokens import blocks, utf8

# The shortest run that the smallest blocks, of 1 << BASE words, are sure to find.
LEAST = 12
BASE = 2
CANDIDATES = 1 << 20  # compared at once


class Names:
    """Names of all stretches of 2**k words, and the sorted suffixes.

    ``ranks[k][i]`` names the stretch at i: the place in the suffix array where its
    range begins. A stretch that no other place has needs no longer ones.
    """

    def __init__(self, keys: np.ndarray) -> None:
        n = len(keys)
        self.order = np.argsort(keys, kind="stable").astype(np.int64)
        rank, fresh = self._named(keys[self.order], np.arange(n), np.empty(n, np.int64), self.order)
        self.ranks, self.sizes = [rank.astype(np.int32)], []
        while True:
            begins = np.flatnonzero(fresh)
            sizes = np.diff(begins, append=n)
            self.sizes.append((begins[sizes > 1], sizes[sizes > 1]))
            begins, sizes = self.sizes[-1]
            if not len(begins):
                break
            # Only places that share their name are sorted on.
            slots = np.repeat(begins - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(sizes.sum())
            places = self.order[slots]
            pairs = rank[places] * n + rank[places + (1 << len(self.ranks) - 1)]
            turn = np.argsort(pairs, kind="stable")
            self.order[slots] = places[turn]
            rank = rank.copy()
            rank, starts = self._named(pairs[turn], slots, rank, places[turn])
            fresh = fresh.copy()
            fresh[slots] = starts
            self.ranks.append(rank.astype(np.int32))

    @staticmethod
    def _named(values, slots, rank, places) -> tuple[np.ndarray, np.ndarray]:
        starts = np.append(True, values[1:] != values[:-1])[: len(values)]
        rank[places] = np.maximum.accumulate(np.where(starts, slots, 0))
        return rank, starts

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i and from j on are equal; i is not j."""
        same = np.zeros(len(i), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            same += (self.ranks[k][i + same] == self.ranks[k][j + same]).astype(np.int64) << k
        return same

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before i and before j are equal; i is less than j."""
        same = np.zeros(len(i), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            back = same + (1 << k)
            inside = i >= back
            low = np.where(inside, i - back, 0)
            same += (inside & (self.ranks[k][low] == self.ranks[k][np.where(inside, j - back, 0)])).astype(np.int64) << k
        return same


class Wavelet:
    """Range successor over an array of distinct values: one bit vector per binary digit,
    the values with 0 there before those with 1."""

    def __init__(self, values: np.ndarray, limit: int) -> None:
        self.digits = max(1, int(limit).bit_length())
        self.zeros = []  # values with 0 in the digit, before each place
        for digit in range(self.digits - 1, -1, -1):
            one = (values >> digit & 1).astype(bool)
            sums = np.zeros(len(values) + 1, np.int32)
            np.cumsum(~one, out=sums[1:])
            self.zeros.append(sums)
            values = np.concatenate([values[~one], values[one]])

    def successor(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The smallest value of ``bound`` or more at places low:high, -1 without one."""
        begin, end = low.copy(), high.copy()
        below = np.zeros(len(low), np.int64)
        for sums, digit in zip(self.zeros, range(self.digits - 1, -1, -1), strict=True):
            zero_begin, zero_end = sums[begin], sums[end]
            one = bound >> digit & 1 == 1
            below += np.where(one, zero_end - zero_begin, 0)
            begin = np.where(one, sums[-1] + begin - zero_begin, zero_begin)
            end = np.where(one, sums[-1] + end - zero_end, zero_end)
        there = (below < high - low) & (bound < 1 << self.digits)
        # The value with as many smaller ones in the range.
        begin, end, place = low.copy(), high.copy(), np.where(there, below, 0)
        value = np.zeros(len(low), np.int64)
        for sums, digit in zip(self.zeros, range(self.digits - 1, -1, -1), strict=True):
            zero_begin, zero_end = sums[begin], sums[end]
            zeros = zero_end - zero_begin
            one = place >= zeros
            place = np.where(one, place - zeros, place)
            value += one.astype(np.int64) << digit
            begin = np.where(one, sums[-1] + begin - zero_begin, zero_begin)
            end = np.where(one, sums[-1] + end - zero_end, zero_end)
        return np.where(there, value, -1)


def _blocks(names: Names, slot_of: np.ndarray) -> tuple[np.ndarray, ...]:
    """(place, length, range begin, range end) of the dyadic blocks that occur again."""
    parts = []
    for k in range(BASE, len(names.ranks)):
        begins, sizes = names.sizes[k]
        size_at = np.zeros(len(slot_of), np.int32)
        size_at[begins] = sizes
        # The smallest blocks overlap by half, to meet the shortest runs.
        step = 1 << (k - 1 if k == BASE else k)
        places = np.arange(0, len(slot_of), step)
        name = names.ranks[k][places]
        again = size_at[name] > 0
        low = slot_of[name[again]]
        parts.append((places[again], np.full(len(low), 1 << k), low, low + size_at[name[again]]))
    if not parts:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(column).astype(np.int64) for column in zip(*parts, strict=True))


def _candidates(names: Names) -> tuple[np.ndarray, np.ndarray]:
    """(place of a block, period it may have)."""
    if len(names.ranks) <= BASE:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # Only stretches of a smallest block that occur again are searched.
    begins, sizes = names.sizes[BASE]
    shared = np.zeros(len(names.order) + 1, np.int64)
    shared[begins] += 1
    np.subtract.at(shared, begins + sizes, 1)
    shared = np.cumsum(shared)[:-1] > 0
    slot_of = np.cumsum(shared) - 1
    tree = Wavelet(names.order[shared], len(names.order))

    at, size, low, high = _blocks(names, slot_of)
    nearest = np.where(size == 1 << BASE, 1, 2 * size - 1)
    farthest = at + 4 * size - 2
    out_at, out_period = [], []

    def progression(first, second, size):
        """Period and last place of the occurrences that follow one another."""
        period = second - first
        reach = names.ahead(first, second) + period
        return period, first + (reach - size) // period * period

    # The block's own period: its multiples are no smallest periods.
    following = tree.successor(low, high, at + 1)
    keep = (following >= 0) & (following <= farthest)
    at, size, low, high, nearest, farthest, following = (
        x[keep] for x in (at, size, low, high, nearest, farthest, following)
    )
    bound = at + nearest
    own = np.flatnonzero(following - at <= size // 2)
    if len(own):
        period, last = progression(at[own], following[own], size[own])
        fits = period >= nearest[own]
        out_at.append(at[own][fits])
        out_period.append(period[fits])
        bound[own] = np.maximum(bound[own], last + 1)
    while len(at):
        first = tree.successor(low, high, bound)
        keep = (first >= 0) & (first <= farthest)
        at, size, low, high, farthest, first = (x[keep] for x in (at, size, low, high, farthest, first))
        if not len(at):
            break
        second = tree.successor(low, high, first + 1)
        period, last = np.ones(len(at), np.int64), first.copy()
        dense = np.flatnonzero((second >= 0) & (second - first <= size // 2))
        if len(dense):
            period[dense], last[dense] = progression(first[dense], second[dense], size[dense])
        members = (np.minimum(last, farthest) - first) // period + 1
        owner = np.repeat(np.arange(len(at)), members)
        rank = np.arange(len(owner)) - np.repeat(np.cumsum(members) - members, members)
        out_at.append(at[owner])
        out_period.append(first[owner] + rank * period[owner] - at[owner])
        bound = last + 1
    if not out_at:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_at), np.concatenate(out_period)


def runs_of(words: np.ndarray, first: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (document, start, length, period) of all runs, in this order.

    ``words`` are numbers, ``words[first[d]:first[d + 1]]`` those of document d.
    """
    if least < LEAST:
        raise ValueError(f"Runs of fewer than {LEAST} words are not searched.")
    docs = len(first) - 1
    nothing = np.zeros((0, 4), np.int64)
    if not len(words):
        return nothing
    # Equal words of different documents differ; every document ends in a mark.
    owner = np.repeat(np.arange(docs), np.diff(first))
    kinds = int(words.max()) + 1
    keys = np.insert(owner * kinds + words, first[1:], docs * kinds + np.arange(docs))
    starts = first[:-1] + np.arange(docs)  # with the marks
    names = Names(keys)
    at, period = _candidates(names)
    found = []
    for lo in range(0, len(at), CANDIDATES):
        i, q = at[lo : lo + CANDIDATES], period[lo : lo + CANDIDATES]
        start = i - names.behind(i, i + q)
        end = i + q + names.ahead(i, i + q)
        long = end - start >= np.maximum(least, 2 * q)
        found.append(np.unique(np.column_stack([start[long], end[long], q[long]]), axis=0))
    if not found:
        return nothing
    runs = np.unique(np.concatenate(found), axis=0)
    smallest = np.ones(len(runs), bool)
    smallest[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[smallest]
    doc = np.searchsorted(starts, runs[:, 0], "right") - 1
    out = np.column_stack([doc, runs[:, 0] - starts[doc], runs[:, 1] - runs[:, 0], runs[:, 2]])
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def find_runs(docs: DataFrame, least: int = LEAST, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, ``runs`` and ``collapsed``.

    ``runs`` is an array of (start, length, period) in words, by start and period. In
    ``collapsed`` each run keeps only its first period: the words that are left, joined by
    one space. Words are what stands between ASCII white space, and differ by case.

    A null or empty text has no words, no runs and an empty collapsed text; a null id
    stays null; repeated rows give a row each; other columns are not read. Runs never
    cross documents. Nothing is shuffled: texts are searched where they lie, some
    megabytes at a time, and a longer text alone; memory is some 150 bytes a word.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                yield _searched(part, least)

    return source.mapInArrow(
        run,
        f"doc_id {id_type}, n_words bigint, "
        "runs array<struct<start:bigint, length:bigint, period:bigint>>, collapsed string",
    )


def _searched(part: pa.RecordBatch, least: int) -> pa.RecordBatch:
    data, at = utf8(part.column("text"))
    raw = data.tobytes()
    number: dict[bytes, int] = defaultdict(count().__next__)
    split = [raw[lo:hi].split() for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    first = np.cumsum([0, *map(len, split)])
    words = np.fromiter((number[w] for doc in split for w in doc), np.int64, first[-1])
    runs = runs_of(words, first, least)
    rows = np.searchsorted(runs[:, 0], np.arange(len(split) + 1))
    collapsed = []
    for doc, (lo, hi) in enumerate(zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True)):
        kept = split[doc]
        if hi > lo:
            change = np.zeros(len(kept) + 1, np.int64)
            np.add.at(change, runs[lo:hi, 1] + runs[lo:hi, 3], 1)
            np.subtract.at(change, runs[lo:hi, 1] + runs[lo:hi, 2], 1)
            stays = np.cumsum(change)[:-1] == 0
            kept = [kept[i] for i in np.flatnonzero(stays).tolist()]
        collapsed.append(b" ".join(kept))
    items = pa.StructArray.from_arrays(
        [pa.array(np.ascontiguousarray(runs[:, k])) for k in (1, 2, 3)], ["start", "length", "period"]
    )
    return pa.RecordBatch.from_arrays(
        [
            part.column("doc_id"),
            pa.array(np.diff(first)),
            pa.ListArray.from_arrays(pa.array(rows.astype(np.int32)), items),
            pa.array(collapsed, pa.binary()).cast(pa.string()),
        ],
        ["doc_id", "n_words", "runs", "collapsed"],
    )


def run_digest(found: DataFrame) -> DataFrame:
    """What ``find_runs`` found as the number of runs, the longest one (ties: smallest
    start, then period) and hashes of all runs and of the collapsed text."""

    def best(name: str) -> Column:
        return F.array_max(
            F.transform(
                "runs",
                lambda r: F.struct(
                    r.length.alias("length"), (-r.start).alias("minus"), (-r.period).alias("fewer")
                ),
            )
        )[name]

    length, start, period = best("length"), -best("minus"), -best("fewer")
    lines = F.transform(
        "runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))
    )
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        start.alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).cast("bigint").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def repeat_tails(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) where a tenth of the texts, by a hash of the id, repeat a
    stretch of theirs to the end.

    With h the crc32 of the id as text and g = h / 10: if h is a multiple of 10, each word
    from a = g % n on becomes word a + (i - a) % p, p = 1 + (n - a) / (3 + g % 8). Such a
    text comes back with one space between its words; the others as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    with_words = docs.select(
        "doc_id",
        "text",
        F.floor(h / 10).alias("__g"),
        F.when(h % 10 == 0, words).alias("__words"),
    )
    n = F.size("__words")
    a = (F.col("__g") % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + F.col("__g") % 8))).cast("int")
    placed = with_words.withColumns({"__a": F.when(n > 0, a), "__p": F.when(n > 0, p)})
    source = F.sequence(F.lit(0), F.size("__words") - 1)
    source = F.transform(
        source, lambda i: F.when(i < F.col("__a"), i).otherwise(F.col("__a") + (i - F.col("__a")) % F.col("__p"))
    )
    repeated = F.array_join(F.transform(source, lambda i: F.get("__words", i)), " ")
    return placed.select("doc_id", F.when(F.col("__a").isNotNull(), repeated).otherwise(F.col("text")).alias("text"))
