"""Cross-tokenizer alignment: which tokens of two vocabularies stand for the same bytes.

Where tokens of both vocabularies end at the same byte, a text is cut; between two cuts
every token of A is linked with every token of B. The count of a pair of ids is the
number of documents that hold it linked, over the whole corpus. Counting goes by spilled
runs, as in an external sort:

1. A task encodes some megabytes of documents, a part, and sorts its records (pair,
   document, links) by radix of the A id, then pair. Each radix of a part becomes one zstd
   run in the shared folder: the pairs with how many documents hold them, and apart
   from that the documents.
2. The pairs and their numbers, much less than the records, move to the task of their
   radix. It merges the runs of all parts with a heap, one A id at a time: the total of
   each pair and the highest total of the id are known when the id has passed, and the
   totals flow back to each run in the order in which it holds its pairs.
3. The totals of a part meet its records, which add them up per document.

So a frequent pair costs its radix one number per part, whatever its documents, and no
task holds more than a part or the numbers of a radix.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.llm.common import store
from sitelens.llm.segments import Coder, Segments, coder

TOKENIZERS = "/opt/tokenizers"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
# Characters and documents of a part; a longer text is a part of its own.
PART_CHARS = 4 << 20
PART_DOCS = 1 << 16

_NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of natural numbers as one zstd frame, the bytes of each place together."""
    out = []
    for values in arrays:
        most = int(values.max()) if len(values) else 0
        width = next(w for w in (1, 2, 4, 8) if most < 1 << 8 * w)
        planes = values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T
        out += [struct.pack("<BQ", width, len(values)), planes.tobytes()]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(out))


def unpack(frame: bytes) -> list[np.ndarray]:
    data, at, out = zstandard.ZstdDecompressor().decompress(frame), 0, []
    while at < len(data):
        width, n = struct.unpack_from("<BQ", data, at)
        at += 9
        planes = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(f"<u{width}").reshape(-1).astype(np.int64))
        at += n * width
    return out


class Radix:
    """Order of pairs by the low bits of their A id, then by A id and B id."""

    def __init__(self, coder: Coder, buckets: int) -> None:
        self.buckets, self.size_b = buckets, coder.size_b
        self.span = -(-coder.size_a // buckets) * coder.size_b  # keys of a bucket

    def keys(self, pairs: np.ndarray) -> np.ndarray:
        a, b = np.divmod(pairs, self.size_b)
        return a % self.buckets * self.span + a // self.buckets * self.size_b + b

    def pair(self, bucket: int, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A id and B id of a bucket's keys."""
        a, b = np.divmod(key, self.size_b)
        return a * self.buckets + bucket, b


def _spilled(seg: Segments, codes: np.ndarray, first: np.ndarray, radix: Radix) -> Iterator[tuple[int, bytes, bytes]]:
    """(bucket, pairs and documents of each, documents and links of each) of a part."""
    docs = len(first) - 1
    n = len(seg.valid)
    owner = np.repeat(np.arange(docs), np.diff(first))
    held, times = np.unique(owner * n + codes, return_counts=True)
    doc, code = np.divmod(held, n)
    many = (seg.first[1:] - seg.first[:-1])[code]
    record = np.repeat(np.arange(len(held)), many)
    pair = np.arange(len(record)) - np.repeat(np.cumsum(many) - many, many) + seg.first[code[record]]
    keys = radix.keys(seg.pairs)[pair] * docs + doc[record]
    links = (seg.times[pair] * times[record]).astype(np.int64)
    del record, pair
    turn = np.argsort(keys)
    keys, links = keys[turn], links[turn]
    begins = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    links = np.add.reduceat(links, begins) if len(begins) else links
    key, doc = np.divmod(keys[begins], docs)
    pair_at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    pairs, holders = key[pair_at], np.diff(pair_at, append=len(key))
    step = np.diff(doc, prepend=0)
    step[pair_at] = doc[pair_at]  # documents of a pair as differences
    bucket = pairs // radix.span
    edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
    for lo, hi in zip(edges.tolist(), [*edges[1:].tolist(), len(bucket)], strict=True) if len(edges) else ():
        mine = pairs[lo:hi] - bucket[lo] * radix.span
        begin, end = pair_at[lo], pair_at[hi] if hi < len(pair_at) else len(key)
        yield (
            int(bucket[lo]),
            pack(np.diff(mine, prepend=0), holders[lo:hi]),
            pack(step[begin:end], links[begin:end]),
        )


def _part(coder: Coder, radix: Radix, texts: list[str | None], with_groups: bool) -> tuple[dict, list]:
    """Columns of the documents of a part, and its runs."""
    number: dict[str, int] = defaultdict(count().__next__)
    split = [coder.split(t or "") for t in texts]
    first = np.cumsum([0, *map(len, split)])
    codes = np.fromiter((number[s] for doc in split for s in doc), np.int64, first[-1])
    del split
    seg = coder.encode(list(number))
    wrong = np.append(0, np.cumsum(~seg.valid[codes]))
    good = np.diff(wrong[first]) == 0
    columns: dict[str, list | np.ndarray] = {}
    for name in _NUMBERS:
        sums = np.append(0, np.cumsum(getattr(seg, name)[codes]))
        columns[name] = np.where(good, np.diff(sums[first]), 0)
    hashes, groups = [], []
    for doc, (lo, hi) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        text = b"".join([seg.groups[c] for c in codes[lo:hi].tolist()])[:-1] if good[doc] else b""
        hashes.append(hashlib.sha256(text).hexdigest() if text else "")
        groups.append(text.decode() if with_groups else None)
    columns |= {"groups_sha256": hashes, "groups": groups}
    keep = np.repeat(good, np.diff(first))
    kept_first = np.append(0, np.cumsum(np.where(good, np.diff(first), 0)))
    return columns, list(_spilled(seg, codes[keep], kept_first, radix))


def _merged(runs: list[tuple[np.ndarray, np.ndarray]], size_b: int) -> Iterator[tuple[int, list, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs (sorted keys, numbers) merged by A id: per id the runs that hold it, its B ids,
    their totals, and for each entry of those runs, in turn, the place of its total."""
    heads = []
    for r, (keys, _) in enumerate(runs):
        a = keys // size_b
        at = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else np.zeros(0, np.int64)
        ids = iter(zip(a[at].tolist(), at.tolist(), [*at[1:].tolist(), len(a)], strict=True)) if len(at) else iter(())
        head = next(ids, None)
        if head:
            heads.append((head[0], r, head[1], head[2], ids))
    heapq.heapify(heads)
    while heads:
        a = heads[0][0]
        holders = []
        while heads and heads[0][0] == a:
            _, r, lo, hi, ids = heads[0]
            holders.append((r, lo, hi))
            following = next(ids, None)
            if following:
                heapq.heapreplace(heads, (following[0], r, following[1], following[2], ids))
            else:
                heapq.heappop(heads)
        b = np.concatenate([runs[r][0][lo:hi] for r, lo, hi in holders]) - a * size_b
        numbers = np.concatenate([runs[r][1][lo:hi] for r, lo, hi in holders])
        ids_b, where = np.unique(b, return_inverse=True)
        totals = np.zeros(len(ids_b), np.int64)
        np.add.at(totals, where, numbers)
        yield a, holders, ids_b, totals, where


def _by_radix(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[int], list[tuple[np.ndarray, np.ndarray]]]]:
    """(bucket, parts, their pairs) of rows sorted by bucket."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    for bucket, group in groupby(rows, key=lambda row: row[0]):
        parts, runs = [], []
        for _, part, tally in group:
            steps, numbers = unpack(tally)
            parts.append(part)
            runs.append((np.cumsum(steps), numbers))
        yield bucket, parts, runs


class Alignment:
    """Documents encoded and their runs spilled; ``documents`` and ``pairs`` count them."""

    def __init__(
        self,
        docs: DataFrame,
        tokenizers: str = TOKENIZERS,
        with_groups: bool = False,
        doc_id: str = "doc_id",
        text: str = "text",
        part_chars: int = PART_CHARS,
    ) -> None:
        spark = docs.sparkSession
        partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
        buckets = 1 << max(4, (partitions - 1).bit_length())
        paths = f"{tokenizers}/{A_FILE}", f"{tokenizers}/{B_FILE}"
        source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
        self.id_type = source.schema["doc_id"].dataType.simpleString()
        self.buckets, self.paths, self.with_groups = buckets, paths, with_groups

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tools = coder(*paths)
            radix = Radix(tools, buckets)
            base, seen = TaskContext.get().partitionId() << 32, count()
            for ids, texts in _parts(batches, part_chars):
                part = base + next(seen)
                columns, runs = _part(tools, radix, texts, with_groups)
                docs = len(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part] * docs, pa.int64()),
                        pa.nulls(docs, pa.int32()),
                        ids,
                        pa.array(np.arange(docs, dtype=np.int32)),
                        *[pa.array(columns[name], pa.int64()) for name in _NUMBERS],
                        pa.array(columns["groups_sha256"], pa.string()),
                        pa.array(columns["groups"], pa.string()),
                        *[pa.nulls(docs, pa.binary())] * 2,
                    ],
                    names,
                )
                for bucket, tally, records in runs:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([part], pa.int64()),
                            pa.array([bucket], pa.int32()),
                            pa.nulls(1, ids.type),
                            pa.nulls(1, pa.int32()),
                            *[pa.nulls(1, pa.int64())] * len(_NUMBERS),
                            *[pa.nulls(1, pa.string())] * 2,
                            pa.array([tally], pa.binary()),
                            pa.array([records], pa.binary()),
                        ],
                        names,
                    )

        names = ["part", "radix", "doc_id", "slot", *_NUMBERS, "groups_sha256", "groups", "tally", "records"]
        numbers = ", ".join(f"{name} bigint" for name in _NUMBERS)
        self.spilled = store(
            source.mapInArrow(
                run,
                f"part bigint, radix int, doc_id {self.id_type}, slot int, {numbers}, "
                "groups_sha256 string, groups string, tally binary, records binary",
            )
        )

    def _tallies(self) -> DataFrame:
        """Every run's pairs at the task of their radix."""
        runs = self.spilled.filter(F.col("radix").isNotNull()).select("radix", "part", "tally")
        return runs.repartition("radix").sortWithinPartitions("radix", "part")

    def pairs(self) -> DataFrame:
        """(a_id, b_id, documents, best): every linked pair of the corpus, how many
        documents hold it, and whether no pair of its A id is held by more."""
        buckets, paths = self.buckets, self.paths

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            radix = Radix(coder(*paths), buckets)
            for bucket, _, runs in _by_radix(batches):
                for a, _, ids_b, totals, _ in _merged(runs, radix.size_b):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(ids_b), a * buckets + bucket)),
                            pa.array(ids_b),
                            pa.array(totals),
                            pa.array(totals == totals.max()),
                        ],
                        ["a_id", "b_id", "documents", "best"],
                    )

        return self._tallies().mapInArrow(run, "a_id bigint, b_id bigint, documents bigint, best boolean")

    def documents(self) -> DataFrame:
        """One row per document: doc_id, numbers of tokens, groups and links, n_best (links
        whose pair has the highest count of its A id), count_sum (counts over links), the
        hash of the groups' ids and, if asked for, their text ``a1,a2|b1;a3|b2,b3``."""
        paths, with_groups = self.paths, self.with_groups

        def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            size_b = coder(*paths).size_b
            for bucket, parts, runs in _by_radix(batches):
                totals_of = [np.zeros(len(keys), np.int64) for keys, _ in runs]
                best_of = [np.zeros(len(keys), np.int64) for keys, _ in runs]
                for _, holders, _, totals, where in _merged(runs, size_b):
                    best = (totals == totals.max()).astype(np.int64)
                    at = 0
                    for r, lo, hi in holders:
                        mine = where[at : at + hi - lo]
                        totals_of[r][lo:hi], best_of[r][lo:hi] = totals[mine], best[mine]
                        at += hi - lo
                for part, totals, best in zip(parts, totals_of, best_of, strict=True):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part]), pa.array([bucket], pa.int32()), pa.array([pack(totals, best)], pa.binary())],
                        ["part", "radix", "totals"],
                    )

        answers = self._tallies().mapInArrow(count_pairs, "part bigint, radix int, totals binary")

        def add_up(rows: pa.Table, answered: pa.Table) -> pa.Table:
            docs = rows.filter(pa.compute.is_null(rows["radix"])).sort_by("slot")
            sums = np.zeros((2, docs.num_rows), np.int64)
            totals_of = dict(zip(answered["radix"].to_pylist(), answered["totals"], strict=True))
            runs = rows.filter(pa.compute.is_valid(rows["radix"]))
            for bucket, tally, records in zip(runs["radix"].to_pylist(), runs["tally"], runs["records"], strict=True):
                holders = unpack(tally.as_py())[1]
                steps, links = unpack(records.as_py())
                totals, best = unpack(totals_of[bucket].as_py())
                first = np.cumsum(holders) - holders
                slot = np.cumsum(steps)
                # Each pair's documents start anew.
                slot -= np.repeat(slot[first] - steps[first], holders)
                np.add.at(sums[0], slot, np.repeat(best, holders) * links)
                np.add.at(sums[1], slot, np.repeat(totals, holders) * links)
            kept = docs.select(["doc_id", *_NUMBERS])
            kept = kept.append_column("n_best", pa.array(sums[0])).append_column("count_sum", pa.array(sums[1]))
            kept = kept.append_column("groups_sha256", docs["groups_sha256"])
            return kept.append_column("groups", docs["groups"]) if with_groups else kept

        numbers = ", ".join(f"{name} bigint" for name in [*_NUMBERS, "n_best", "count_sum"])
        schema = f"doc_id {self.id_type}, {numbers}, groups_sha256 string" + (", groups string" if with_groups else "")
        unread = [] if with_groups else ["groups"]
        return self.spilled.drop(*unread).groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(add_up, schema)


def _parts(batches: Iterator[pa.RecordBatch], part_chars: int) -> Iterator[tuple[pa.Array, list[str | None]]]:
    """Ids and texts of one part after another."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, text in enumerate(batch.column("text")):
            text = text.as_py()
            here = len(text) if text else 0
            if texts and (size + here > part_chars or len(texts) >= PART_DOCS):
                yield pa.concat_arrays(ids), texts
                ids, texts, size = [], [], 0
            ids.append(batch.column("doc_id").slice(i, 1))
            texts.append(text)
            size += here
    if texts:
        yield pa.concat_arrays(ids), texts


def align(docs: DataFrame, tokenizers: str = TOKENIZERS, with_groups: bool = True, **options) -> DataFrame:
    """The documents of an ``Alignment``.

    A text that is null or empty, or that a tokenizer does not give back byte by byte
    (U+2581 in a text reads as a space), has no tokens: zeros and empty groups, and its
    links are not counted. Strings of special tokens are plain text. A null id stays null;
    repeated rows give a row each and count as documents each; other columns are not read.
    ``tokenizers`` is the folder of the vocabulary files, on every executor.
    """
    return Alignment(docs, tokenizers, with_groups, **options).documents()
