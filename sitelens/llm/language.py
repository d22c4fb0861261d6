"""Language identification by interpolated Kneser-Ney character models.

Characters are lower-cased letters; every run of other characters is one boundary. One
model per language of the given order; counts come from all training rows. The key of an
n-gram is a 64-bit hash made from the key of its context and its last character, so
n-grams do not share counts. A model is, per order, sorted arrays of the keys that its
language has with their values, as long as it has n-grams; a lookup is a binary search.

Counts become probabilities in Spark. Up to ``MODEL_ENTRIES`` entries the models are
broadcast; larger ones stay a table, and the n-grams of the texts are joined with them.
Both give the same scores.

The language with the lowest cross-entropy per character wins; the score is its share
of the probabilities at the text's length capped by ``SCORE_CHARS``. A text is rejected
when its cross-entropy lies above what ``1 - REJECT`` of the training rows of that
language reach. Defined results: a null text and one without a letter give ``und`` and
score 0; rows without a language are not learned from; an empty table gives an empty
result, and without any training row every language is ``und``. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import count
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.llm import tokens
from sitelens.llm.common import store

ORDER = 4
# Entries of the models (n-grams and contexts of all orders and languages) that tasks get,
# of 12 bytes each. Larger models are joined as a table.
MODEL_ENTRIES = 8_000_000
# Rows of a table that is sent to all tasks as it is, at most.
MAX_BROADCAST = 100_000
# Odd base of the keys.
BASE = 0x9E3779B97F4A7C15
DISCOUNT = 0.75
SCORE_CHARS = 200
REJECT = 0.001
# Characters scored at once.
PIECE = 1 << 20
UNKNOWN = "und"


@lru_cache(1)
def letters() -> np.ndarray:
    """Lower-cased letter of every code point, 0 for what is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for point in range(0x110000):
        char = chr(point)
        if char.isalpha():
            out[point] = ord(char.lower()[0])
    return out


def folded(part: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all rows, and where each row starts: ``order - 1`` boundaries, its
    letters with single boundaries between words, and a boundary."""
    table = letters()
    rows = []
    for text in part.to_pylist():
        points = np.frombuffer((text or "").encode("utf-32-le", "replace"), np.uint32)
        found = table[points]
        letter = found > 0
        keep = letter.copy()
        keep[1:-1] |= letter[:-2]  # a run of other characters leaves its first
        inner = found[keep]
        if len(inner) and not inner[-1]:
            inner = inner[:-1]
        rows.append(np.concatenate([np.zeros(order - 1, np.uint32), inner, [0]]).astype(np.uint32))
    at = np.zeros(len(rows) + 1, np.int64)
    np.cumsum([len(r) for r in rows], out=at[1:])
    return (np.concatenate(rows) if rows else np.zeros(0, np.uint32)), at


def gram_keys(points: np.ndarray, order: int) -> np.ndarray:
    """keys[n][i] is the key of the n-gram that ends at i; valid from ``order - 1`` on."""
    keys = np.zeros((order + 1, len(points)), np.uint64)
    own = points.astype(np.uint64) + np.uint64(1)
    for n in range(1, order + 1):
        np.multiply(keys[n - 1][:-1], np.uint64(BASE), out=keys[n][1:])
        keys[n] += own
    return keys


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each value comes first, and for each key the number of its value."""
    codes, values = pd.factorize(keys)
    first = np.empty(len(values), np.int64)
    first[codes[::-1]] = np.arange(len(keys) - 1, -1, -1)
    return first, codes


def _predicted(at: np.ndarray, size: int, order: int) -> np.ndarray:
    """The characters that a model predicts: all but the boundaries before each row."""
    use = np.ones(size, bool)
    for k in range(order - 1):
        use[at[:-1] + k] = False
    return use


def _columns(order: int) -> list[str]:
    """An n-gram with all that probabilities need: its own key and those of the shorter
    n-grams that end there (g), and the keys of their contexts (c)."""
    return [*(f"g{n}" for n in range(order, 0, -1)), *(f"c{n}" for n in range(order - 1, 0, -1))]


def _keys_at(keys: np.ndarray, where: np.ndarray, order: int) -> list[np.ndarray]:
    grams = [keys[n][where] for n in range(order, 0, -1)]
    return [*grams, *(keys[n][where - 1] for n in range(order - 1, 0, -1))]


def count_grams(docs: DataFrame, lang: str, text: str, order: int) -> DataFrame:
    """lang, the keys of ``_columns``, letter and times of each n-gram over all rows."""
    names = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    columns = _columns(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.blocks(batch, "text"):
                points, at = folded(part.column("text"), order)
                keys = gram_keys(points, order)
                size = np.diff(at)
                use = np.flatnonzero(
                    _predicted(at, len(points), order) & np.repeat(size > order, size)
                )
                own, languages = pd.factorize(np.array(part.column("lang").to_pylist(), object))
                code = own[np.repeat(np.arange(len(size)), size)[use]]
                use = use[np.argsort(code, kind="stable")]
                cut = np.cumsum(np.bincount(code, minlength=len(languages)))
                for name, where in zip(languages, np.split(use, cut[:-1]) if len(cut) else (), strict=True):
                    begin, codes = distinct(keys[order][where])
                    first = where[begin]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([name] * len(first), pa.string()),
                            *(pa.array(row.view(np.int64)) for row in _keys_at(keys, first, order)),
                            pa.array(points[first].astype(np.int64)),
                            pa.array(np.bincount(codes, minlength=len(first)).astype(np.int64)),
                        ],
                        ["lang", *columns, "letter", "times"],
                    )

    typed = ", ".join(f"{c} long" for c in [*columns, "letter", "times"])
    same = [F.first(c).alias(c) for c in [*columns[1:], "letter"]]
    return (
        names.mapInArrow(run, f"lang string, {typed}")
        .groupBy("lang", columns[0])
        .agg(*same, F.sum("times").alias("times"))
        .select("lang", *columns, "letter", "times")
    )


def model_table(counts: DataFrame, order: int) -> DataFrame:
    """The models as rows (lang, n, part, key, value): for n-grams (part ``own``) their part
    of the probability, for contexts (``left``) the weight of the next lower order."""
    columns = _columns(order)
    level, parts = counts.drop("letter"), []
    for n in range(order, 0, -1):
        context = F.col(f"c{n - 1}") if n > 1 else F.lit(0).cast("long")
        entries = level.select("lang", F.col(f"g{n}").alias("key"), context.alias("context"), "times")
        sums = entries.groupBy("lang", "context").agg(
            F.sum("times").alias("total"), F.count(F.lit(1)).alias("kinds")
        )
        own = F.greatest(F.col("times") - DISCOUNT, F.lit(0.0)) / F.col("total")
        parts.append(
            entries.join(sums, ["lang", "context"])
            .select("lang", F.lit(n).alias("n"), F.lit("own").alias("part"), "key", own.alias("value"))
        )
        back = F.lit(DISCOUNT) * F.col("kinds") / F.col("total")
        parts.append(
            sums.select(
                "lang", F.lit(n - 1).alias("n"), F.lit("left").alias("part"), F.col("context").alias("key"), back.alias("value")
            )
        )
        if n > 1:
            # A lower order counts in how many ways its n-grams are continued to the left.
            rest = [c for c in columns if int(c[1:]) < n and c != f"c{n - 1}"]
            level = level.groupBy("lang", f"g{n - 1}").agg(
                *[F.first(c).alias(c) for c in rest if c != f"g{n - 1}"], F.count(F.lit(1)).alias("times")
            )
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    return table


class Model(NamedTuple):
    """Languages, size of the alphabet and, by (language, n, part), sorted keys and values."""

    languages: list[str]
    order: int
    alphabet: int
    arrays: dict[tuple[str, int, str], tuple[np.ndarray, np.ndarray]]

    def _values(self, language: str, n: int, part: str, keys: np.ndarray, missing: float) -> np.ndarray:
        known, values = self.arrays.get((language, n, part), (np.zeros(0, np.uint64), np.zeros(0)))
        if not len(known):
            return np.full(len(keys), missing)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return np.where(known[at] == keys, values[at], missing)

    def probability(self, columns: dict[str, np.ndarray]) -> np.ndarray:
        """P(last character | the ones before) by n-gram and language."""
        size = len(columns["g1"])
        out = np.full((size, len(self.languages)), 1 / self.alphabet)
        for k, language in enumerate(self.languages):
            for n in range(1, self.order + 1):
                context = columns[f"c{n - 1}"] if n > 1 else np.zeros(size, np.uint64)
                left = self._values(language, n - 1, "left", context, 1.0)
                out[:, k] = self._values(language, n, "own", columns[f"g{n}"], 0.0) + left * out[:, k]
        return out


def fit(table: DataFrame, languages: list[str], alphabet: int, order: int = ORDER) -> Model:
    """The models of a table of at most ``MODEL_ENTRIES`` rows."""
    rows = table.toArrow()
    arrays = {}
    if rows.num_rows:
        keys, values = rows["key"].to_numpy().view(np.uint64), rows["value"].to_numpy().astype(np.float32)
        kind = [rows[c].combine_chunks().dictionary_encode() for c in ("lang", "n", "part")]
        codes = [k.indices.to_numpy().astype(np.int64) for k in kind]
        names = [k.dictionary.to_pylist() for k in kind]
        group = (codes[0] * len(names[1]) + codes[1]) * len(names[2]) + codes[2]
        turn = np.lexsort((keys, group))
        first = np.flatnonzero(np.append(True, np.diff(group[turn]) != 0))
        for lo, hi in zip(first, np.append(first[1:], len(turn)), strict=True):
            mine = turn[lo:hi]
            name = tuple(names[k][codes[k][mine[0]]] for k in range(3))
            arrays[name] = keys[mine], values[mine]
    return Model(languages, order, alphabet, arrays)


def cross_entropies(part: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Characters of each row, and its bits per character under each language."""
    order = model.order
    points, at = folded(part, order)
    keys = gram_keys(points, order)
    columns = _columns(order)
    total = np.zeros((len(at) - 1, len(model.languages)))
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    use = np.flatnonzero(_predicted(at, len(points), order))
    for lo in range(0, len(use), PIECE):
        where = use[lo : lo + PIECE]
        begin, back = distinct(keys[order][where])
        grams = dict(zip(columns, _keys_at(keys, where[begin], order), strict=True))
        logs = -np.log2(model.probability(grams))[back]
        of = row[where]
        first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        total[of[first]] += np.add.reduceat(logs, first)
    size = np.diff(at) - order  # without the boundaries at both ends
    return size, total / np.maximum(size + 1, 1)[:, None]


def joined_entropies(docs: DataFrame, model: DataFrame, languages: list[str], alphabet: int, order: int, keep: list[str], text: str) -> DataFrame:
    """``keep``, chars and ``bits`` (per character, an array by language) of every row, by
    joins with the table of the models."""
    columns = _columns(order)
    rows = docs.select(*keep, F.col(text).alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    names = ["__row", *keep, "chars", *columns, "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, seen = TaskContext.get().partitionId() << 33, count()
        for batch in batches:
            for part in tokens.blocks(batch, "__text"):
                points, at = folded(part.column("__text"), order)
                keys = gram_keys(points, order)
                for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
                    number = base + next(seen)
                    where = np.arange(a + order - 1, b)
                    begin, codes = distinct(keys[order][where])
                    times = np.bincount(codes, minlength=len(begin))
                    grams = _keys_at(keys, where[begin], order)
                    n = len(begin)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([number] * n, pa.int64()),
                            *(pa.array(part.column(c).slice(i, 1).to_pylist() * n, part.column(c).type) for c in keep),
                            pa.array([b - a - order] * n, pa.int64()),
                            *(pa.array(g.view(np.int64)) for g in grams),
                            pa.array(times.astype(np.int64)),
                        ],
                        names,
                    )

    typed = ", ".join(f"{c} long" for c in ["chars", *columns, "times"])
    found = store(rows.mapInArrow(run, f"__row long, {kinds + ', ' if kinds else ''}{typed}"))
    number = F.explode(F.sequence(F.lit(0), F.lit(len(languages) - 1))).alias("__lang")
    grams = found.groupBy(columns[0]).agg(*[F.first(c).alias(c) for c in columns[1:]]).select("*", number)
    codes = F.create_map(*[x for k, name in enumerate(languages) for x in (F.lit(name), F.lit(k))])
    table = model.select("*", codes[F.col("lang")].alias("__lang"))
    chance = F.lit(1 / alphabet)
    for n in range(1, order + 1):
        for part, key, order_of in (("left", f"c{n - 1}", n - 1), ("own", f"g{n}", n)):
            entries = table.filter((F.col("n") == order_of) & (F.col("part") == part))
            name = f"__{part}{n}"
            if key == "c0":
                grams = grams.join(entries.select("__lang", F.col("value").alias(name)), "__lang", "left")
            else:
                grams = grams.join(
                    entries.select("__lang", F.col("key").alias(key), F.col("value").alias(name)), ["__lang", key], "left"
                )
        chance = F.coalesce(f"__own{n}", F.lit(0.0)) + F.coalesce(f"__left{n}", F.lit(1.0)) * chance
    bits = grams.select(columns[0], "__lang", (-F.log2(chance)).alias("__bits"))
    summed = (
        found.select("__row", columns[0], "times").join(bits, columns[0])
        .groupBy("__row", "__lang").agg(F.sum(F.col("times") * F.col("__bits")).alias("__bits"))
        .groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("__lang", "__bits"))).alias("__all"))
    )
    each = found.groupBy("__row").agg(*[F.first(c).alias(c) for c in [*keep, "chars"]])
    return each.join(summed, "__row").select(
        *keep, "chars", F.transform("__all", lambda x: x["__bits"] / (F.col("chars") + 1)).alias("bits")
    )


def _decided(size: np.ndarray, bits: np.ndarray, languages: list[str]) -> list[pa.Array]:
    """chars, lang_pred, entropy and score of rows with their bits by language."""
    none = size <= 0
    if languages:
        best = bits.argmin(1)
        low = bits[np.arange(len(best)), best]
        length = np.clip(size, 0, SCORE_CHARS)[:, None]
        share = 1 / np.exp2((low[:, None] - bits) * length).sum(1)
    else:
        best, low, share = np.zeros(len(size), int), np.zeros(len(size)), np.zeros(len(size))
    best = np.where(none, len(languages), best)
    return [
        pa.array(np.maximum(size, 0)),
        pa.array(list(np.array([*languages, UNKNOWN], object)[best]), pa.string()),
        pa.array(np.where(none, np.nan, low), from_pandas=True),
        pa.array(np.where(none, 0.0, share)),
    ]


def scores(docs: DataFrame, counts: DataFrame, order: int, keep: list[str], text: str, entries: int = MODEL_ENTRIES) -> DataFrame:
    """``keep`` with chars, lang_pred, entropy and score of every row; ``counts`` stored."""
    # The languages and the letters they use: as long as their lists, whatever the corpus.
    languages = sorted(r[0] for r in counts.select("lang").distinct().collect())
    alphabet = counts.select("letter").distinct().count() + 1  # one for all unseen letters
    table = store(model_table(counts, order))
    names = [*keep, "chars", "lang_pred", "entropy", "score"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    schema = f"{kinds}, chars long, lang_pred string, entropy double, score double"
    if not languages or table.count() <= entries:
        shared = docs.sparkSession.sparkContext.broadcast(fit(table, languages, alphabet, order))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = shared.value
            for batch in batches:
                for part in tokens.blocks(batch, "__text"):
                    size, bits = cross_entropies(part.column("__text"), model)
                    decided = _decided(size, bits, model.languages)
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *decided], names)

        return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("bits").flatten().to_numpy(zero_copy_only=False)
            decided = _decided(
                batch.column("chars").to_numpy(), flat.reshape(batch.num_rows, len(languages)), languages
            )
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *decided], names)

    return joined_entropies(docs, table, languages, alphabet, order, keep, text).mapInArrow(decide, schema)


def identify(
    docs: DataFrame,
    train: Column,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    order: int = ORDER,
    reject: float = REJECT,
    entries: int = MODEL_ENTRIES,
) -> DataFrame:
    """doc_id, lang_pred, score, entropy and rejected of every row.

    Models and thresholds are learned from rows where ``train`` holds and ``lang`` is
    not null; predictions read the text only.
    """
    learned = F.coalesce(train, F.lit(False)) & F.col(lang).isNotNull()
    counts = store(count_grams(docs.filter(learned), lang, text, order))
    marked = docs.select(
        F.col(doc_id).alias("id"),
        F.when(learned, F.col(lang)).alias("known"),
        F.col(text).alias("body"),
    )
    found = store(scores(marked, counts, order, ["id", "known"], "body", entries))
    limits = (
        found.filter(F.col("known") == F.col("lang_pred"))
        .groupBy("lang_pred")
        .agg(F.percentile_approx("entropy", 1 - reject, 10000).alias("limit"))
    )
    limits = store(limits)  # a row per learned language
    small = F.broadcast(limits) if limits.count() <= MAX_BROADCAST else limits
    return found.join(small, "lang_pred", "left").select(
        F.col("id").alias(doc_id),
        "lang_pred",
        "score",
        "entropy",
        (F.coalesce(F.col("entropy") > F.col("limit"), F.lit(False))).alias("rejected"),
    )
