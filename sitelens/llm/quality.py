"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from the text alone, for all texts, in one pass over Arrow buffers.
The trees are grown on a sample of at most ``MAX_ROWS`` labelled rows, chosen by a hash
of the id; the statistics of each row are put into at most 64 bins, and a split is
found from histograms of gradients. Trees are kept as flat arrays (feature, threshold,
left, right, value), which numpy walks for all rows of a batch at once.

Defined results: a null or empty text has the statistics 0 and gets the score of such a
text; labels other than 0 and 1, null labels and labels without a document are left
out; a document with several labels is learned from once for each; without labels of
both kinds every score is the share of label 1 (0.5 without labels). Extra columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.llm import tokens
from sitelens.llm.common import store

# Labelled rows that a model is fitted on, at most.
MAX_ROWS = 40_000
BINS = 64
TREES = 80
LEAVES = 15
MIN_LEAF = 10
RATE = 0.15
SMOOTH = 1.0

STATISTICS = [
    "log_bytes", "log_words", "word_bytes", "long_words", "upper", "digits", "spaces",
    "sentence_marks", "other_marks", "wide", "distinct_words", "repeats", "word_top",
    "marked_words", "upper_words", "log_lines", "line_words", "distinct_lines",
    "distinct_pairs", "stops_per_word",
]

_BYTE = np.arange(256)
_UPPER = (_BYTE >= 0x41) & (_BYTE <= 0x5A)
_DIGIT = (_BYTE >= 0x30) & (_BYTE <= 0x39)
_LETTER = _UPPER | ((_BYTE >= 0x61) & (_BYTE <= 0x7A)) | (_BYTE >= 0x80)
_SPACE = np.isin(_BYTE, [0x20, *range(9, 14)])
_SENTENCE = np.isin(_BYTE, [ord(c) for c in ".,;:?"])
_STOP = np.isin(_BYTE, [ord(c) for c in ".?"])
_OTHER = ~(_LETTER | _DIGIT | _SPACE | _SENTENCE)


def _counts(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=sums[1:])
    return sums[at[1:]] - sums[at[:-1]]


def _distinct(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each row, and the times of its most frequent one."""
    kinds, top = np.zeros(len(first) - 1), np.zeros(len(first) - 1)
    for row, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
        if b > a:
            own = np.sort(values[a:b])
            runs = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            kinds[row] = len(runs)
            top[row] = np.diff(np.append(runs, len(own))).max()
    return kinds, top


def statistics(column: pa.Array) -> np.ndarray:
    """One row of STATISTICS per text."""
    data, at = tokens.utf8(column)
    found = tokens.words(data, at, "space")
    size = np.diff(at).astype(float)
    n = np.diff(found.first).astype(float)
    per_byte, per_word = np.maximum(size, 1), np.maximum(n, 1)
    row = np.repeat(np.arange(len(n)), np.diff(found.first))

    def by_word(mask: np.ndarray) -> np.ndarray:
        return np.bincount(row, mask, len(n)) / per_word

    long = found.ends - found.starts
    last = data[np.maximum(found.ends - 1, 0)] if len(data) else np.zeros(0, np.uint8)
    upper = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_UPPER[data], out=upper[1:])
    shouted = (upper[found.ends] - upper[found.starts]) * 2 > long
    repeat = np.zeros(len(row), bool)
    repeat[1:] = (found.hashes[1:] == found.hashes[:-1]) & (row[1:] == row[:-1])
    kinds, top = _distinct(found.hashes, found.first)
    pairs = tokens.windows(found.hashes, 2)
    pairs = np.append(pairs, np.zeros(min(1, len(found.hashes)), np.uint64))
    pair_kinds, _ = _distinct(pairs, found.first)
    ends = np.flatnonzero(data == 0x0A)
    lines = np.searchsorted(ends, at[1:]) - np.searchsorted(ends, at[:-1]) + 1.0
    begin = np.union1d(at[:-1][size > 0], ends + 1)
    begin = begin[begin < len(data)]
    words_before = np.searchsorted(found.starts, begin)
    sums = np.zeros(len(found.hashes) + 1, np.uint64)
    np.cumsum(found.hashes, out=sums[1:])
    stop = np.append(words_before[1:], len(found.hashes))
    stop = np.minimum(stop, found.first[1:][np.searchsorted(at, begin, "right") - 1])
    line_hash = sums[stop] - sums[words_before]
    line_kinds, _ = _distinct(line_hash, np.searchsorted(begin, at))
    columns = [
        np.log1p(size), np.log1p(n), by_word(long), by_word(long > 12),
        _counts(_UPPER[data], at) / per_byte, _counts(_DIGIT[data], at) / per_byte,
        _counts(_SPACE[data], at) / per_byte, _counts(_SENTENCE[data], at) / per_byte,
        _counts(_OTHER[data], at) / per_byte, _counts(data >= 0x80, at) / per_byte,
        kinds / per_word, by_word(repeat), top / per_word, by_word(_OTHER[last]),
        by_word(shouted), np.log1p(lines), n / lines, line_kinds / lines,
        pair_kinds / per_word, _counts(_STOP[data], at) / per_word,
    ]
    return np.stack(columns, 1).astype(np.float32)


class Trees(NamedTuple):
    """Nodes of all trees end to end; a leaf points to itself. ``roots`` starts each tree."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def margin(self, rows: np.ndarray) -> np.ndarray:
        total = np.full(len(rows), self.base)
        every = np.arange(len(rows))
        for root in self.roots:
            node = np.full(len(rows), root)
            for _ in range(self.depth):
                low = rows[every, self.feature[node]] <= self.threshold[node]
                node = np.where(low, self.left[node], self.right[node])
            total += self.value[node]
        return total

    def score(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(rows)))


def _bin_edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1], method="lower"))


def _best_split(hist: np.ndarray, min_leaf: int) -> tuple[float, int, int]:
    """(gain, feature, bin) of the best split of a (features, bins, 3) histogram."""
    below = np.cumsum(hist, axis=1)
    total = below[:, -1:, :]
    above = total - below
    gain = (
        below[..., 0] ** 2 / (below[..., 1] + SMOOTH)
        + above[..., 0] ** 2 / (above[..., 1] + SMOOTH)
        - total[..., 0] ** 2 / (total[..., 1] + SMOOTH)
    )
    gain[(below[..., 2] < min_leaf) | (above[..., 2] < min_leaf)] = -np.inf
    at = int(np.argmax(gain))
    return float(gain.flat[at]), at // gain.shape[1], at % gain.shape[1]


def grow(
    rows: np.ndarray, label: np.ndarray, trees: int = TREES, leaves: int = LEAVES,
    rate: float = RATE, bins: int = BINS, min_leaf: int = MIN_LEAF,
) -> Trees:
    """Boosted trees with logistic loss, each grown leaf by leaf where the gain is largest."""
    share = label.mean() if len(label) else 0.5
    flat: list[list] = [[], [], [], [], []]
    roots: list[int] = []
    base = float(np.log(max(share, 1e-3) / max(1 - share, 1e-3)))
    depth = 0
    if len(label) and 0 < share < 1:
        edges = [_bin_edges(c, bins) for c in rows.T]
        binned = np.stack([np.searchsorted(e, c) for e, c in zip(edges, rows.T, strict=True)], 1)
        width = rows.shape[1]
        cell = binned + np.arange(width) * bins
        margin = np.full(len(rows), base)

        def histogram(at: np.ndarray, slope: np.ndarray, curve: np.ndarray) -> np.ndarray:
            where = cell[at].ravel()
            weights = [slope[at], curve[at], np.ones(len(at))]
            counted = [np.bincount(where, np.repeat(w, width), width * bins) for w in weights]
            return np.stack(counted, 1).reshape(width, bins, 3)

        for _ in range(trees):
            chance = 1 / (1 + np.exp(-margin))
            slope, curve = label - chance, chance * (1 - chance)
            start = len(flat[0])
            roots.append(start)

            def leaf(at: np.ndarray, start: int = start, slope=slope, curve=curve) -> dict:
                node = len(flat[0])
                value = rate * slope[at].sum() / (curve[at].sum() + SMOOTH)
                for store_in, x in zip(flat, (0, np.inf, node, node, value), strict=True):
                    store_in.append(x)
                margin[at] += value
                hist = histogram(at, slope, curve)
                return {"node": node, "rows": at, "split": _best_split(hist, min_leaf), "depth": 0}

            open_leaves = [leaf(np.arange(len(rows)))]
            while len(open_leaves) < leaves:
                top = max(open_leaves, key=lambda x: x["split"][0])
                gain, feature, cut = top["split"]
                if gain <= 1e-6 or cut >= len(edges[feature]):
                    break
                open_leaves.remove(top)
                at, node = top["rows"], top["node"]
                margin[at] -= flat[4][node]
                low = binned[at, feature] <= cut
                both = [leaf(at[low]), leaf(at[~low])]
                for child in both:
                    child["depth"] = top["depth"] + 1
                    depth = max(depth, child["depth"])
                flat[0][node], flat[1][node] = feature, float(edges[feature][cut])
                flat[2][node], flat[3][node] = both[0]["node"], both[1]["node"]
                flat[4][node] = 0.0
                open_leaves += both
    kinds = (np.int32, np.float32, np.int32, np.int32, np.float64)
    arrays = [np.array(x, k) for x, k in zip(flat, kinds, strict=True)]
    return Trees(base, np.array(roots, np.int32), *arrays, depth)


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and its statistics, as one array, for every row."""
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.blocks(batch, "text"):
                found = statistics(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), tokens.lists(list(found), pa.float32())], ["id", "found"]
                )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, found array<float>")


def sample(rows: DataFrame, max_rows: int) -> DataFrame:
    """At most about ``max_rows`` rows, chosen by a hash of the id alone."""
    count = rows.count()
    if count <= max_rows:
        return rows
    keep = int(max_rows / count * 0.98 * 10**6)
    return rows.filter(F.pmod(F.xxhash64("id"), F.lit(10**6)) < keep)


def score(
    docs: DataFrame,
    labels: DataFrame,
    train: Column,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    max_rows: int = MAX_ROWS,
) -> DataFrame:
    """doc_id, score and predicted of every row; ``train`` tells which labels are learned from.

    Statistics are written once, then joined with the labels and scored; texts are read
    once and not shuffled.
    """
    found = store(measured(docs, doc_id, text))
    known = labels.filter(F.coalesce(train, F.lit(False)) & F.col(label).isin(0, 1)).select(
        F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label")
    )
    chosen = sample(found.join(known, "id"), max_rows).orderBy("id", "label").toArrow()
    width = len(STATISTICS)
    flat = chosen["found"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    trees = grow(flat.reshape(-1, width), chosen["label"].to_numpy().astype(float))
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("found").flatten().to_numpy(zero_copy_only=False)
            chance = shared.value.score(rows.reshape(-1, width))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(chance), pa.array((chance >= 0.5).astype(np.int32))],
                [doc_id, "score", "predicted"],
            )

    kind = found.schema["id"].dataType.simpleString()
    return found.mapInArrow(run, f"{doc_id} {kind}, score double, predicted int")
