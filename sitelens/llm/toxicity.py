"""Toxicity by a learned lexicon, Levenshtein automata and context windows.

The lexicon is learned from a sample of at most ``MAX_ROWS`` distinct labelled texts of
each label: whole words of any length and stems (first letters of words) that occur in
toxic texts and hardly in others. Copies of a text are one text here, however many there are, and weigh
as many only in the regression. A term must stand in ``MIN_DOCS`` different contexts
(the words on both sides); where one context has most of its texts, those that differ
from it on one side only are near copies and do not count: near copies thus add their
insults, not all of their words. A stem counts only where it is more than its best word.

A text's words meet the lexicon as a trie, walked by a Levenshtein automaton of
distance 1 (terms of five letters and more), so that misspelled terms are caught. By the
pigeonhole principle such a word starts with the first half of its term or ends with
the second; hashes of word starts and ends, for all words of a batch at once, leave only
those words to the automaton. Around each hit a window of ``WINDOW`` bytes on both sides
tells quotation (quote marks on both sides, or a reporting word) from abuse. A logistic
regression over the counts of both, fitted on the sample, gives the score.

Defined results: a null or empty text has no hits and gets the score of such a text;
labels other than 0 and 1 are left out; without toxic labels the lexicon is empty and all
scores are the share of label 1 (0.5 without any labels). Extra columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.llm import tokens
from sitelens.llm.common import store

# Distinct texts of each label that the lexicon and the weights are fitted on, at most.
MAX_ROWS = 10_000
# Toxic texts that show a term, and its contexts: so many at least, and this share of the texts.
MIN_DOCS = 5
MIN_SHARE = 0.005
# A stem has so many times the texts of the best term it begins.
STEM_GAIN = 1.25
# A term is at least so many times likelier in toxic texts than in others.
MIN_RATIO = 25
STEMS = (4, 5, 6, 7, 8)
FUZZY_LETTERS = 5
WINDOW = 60
WORD = re.compile(r"[^\W_]+")
QUOTES = re.compile("[\"“”„«»‹›]")
REPORTING = re.compile(
    r"\b(?:said|says|called|quote|quoted|quoting|word|term|insult|insults|slur|wrote)\b"
)


class Trie:
    """Terms letter by letter; the value of a node is the (term, is_stem) that ends there."""

    def __init__(self, terms: list[tuple[str, bool]]) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[tuple[str, bool] | None] = [None]
        for term, stem in terms:
            node = 0
            for letter in term:
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.ends.append(None)
                node = self.children[node][letter]
            self.ends[node] = (term, stem)

    def match(self, word: str) -> tuple[str, int] | None:
        """The nearest term within distance 1 and its distance; stems match exactly.

        The automaton's state is its row of edit distances; a path of the trie is left
        as soon as no entry of the row is within the distance.
        """
        best: tuple[int, int, str] | None = None
        rows = [(0, list(range(len(word) + 1)), 0)]
        while rows:
            node, row, depth = rows.pop()
            if end := self.ends[node]:
                term, stem = end
                far = 0 if stem and row[min(depth, len(word))] == 0 else row[-1]
                near = far == 0 or far == 1 and not stem and len(term) >= FUZZY_LETTERS
                if near and (best is None or (far, -len(term), term) < best):
                    best = (far, -len(term), term)
            for letter, child in self.children[node].items():
                new = [row[0] + 1]
                for i, own in enumerate(word):
                    new.append(min(new[i] + 1, row[i + 1] + 1, row[i] + (own != letter)))
                if min(new) <= 1:
                    rows.append((child, new, depth + 1))
        return (best[2], best[0]) if best else None


class Lexicon(NamedTuple):
    """Terms, and which starts and ends of words may belong to one."""

    terms: list[tuple[str, bool]]
    starts: dict[int, np.ndarray]
    ends: dict[int, np.ndarray]


def _hash(piece: str) -> int:
    data = np.frombuffer(piece.encode(), np.uint8)
    return int(tokens.words(data, np.array([0, len(data)]), "alnum").hashes[0])


def lexicon(terms: list[tuple[str, bool]]) -> Lexicon:
    starts: dict[int, set[int]] = {}
    ends: dict[int, set[int]] = {}
    for term, stem in terms:
        if stem or len(term) < FUZZY_LETTERS:
            starts.setdefault(len(term.encode()), set()).add(_hash(term))
        else:
            half = len(term) // 2
            for piece, side in ((term[:half], starts), (term[half:], ends)):
                side.setdefault(len(piece.encode()), set()).add(_hash(piece))
    pack = lambda side: {n: np.array(sorted(x), np.uint64) for n, x in side.items()}
    return Lexicon(terms, pack(starts), pack(ends))


def _suspects(data: np.ndarray, found: tokens.Words, known: Lexicon) -> np.ndarray:
    """Words that begin or end as some term does."""
    size = found.ends - found.starts
    hit = np.zeros(len(size), bool)
    for side, from_start in ((known.starts, True), (known.ends, False)):
        for n, wanted in side.items():
            at = np.flatnonzero((size >= n) & ~hit)
            begin = found.starts[at] if from_start else found.ends[at] - n
            hashes = tokens.spans(data, begin, n)
            place = np.minimum(np.searchsorted(wanted, hashes), len(wanted) - 1)
            hit[at] = wanted[place] == hashes
    return np.flatnonzero(hit)


FEATURES = ["abuse", "any_abuse", "misspelled", "quoted", "close"]


def hits(column: pa.Array, known: Lexicon, trie: Trie, memo: dict) -> tuple[np.ndarray, list]:
    """FEATURES of each text, and its terms."""
    data, at = tokens.utf8(pc.utf8_lower(column))
    found = tokens.words(data, at, "alnum")
    out = np.zeros((len(column), len(FEATURES)), np.float64)
    terms: list[list[str]] = [[] for _ in range(len(column))]
    chosen = _suspects(data, found, known) if known.terms else np.zeros(0, np.int64)
    rows = np.searchsorted(found.first, chosen, "right") - 1
    before = (-1, -100)
    for row, word in zip(rows.tolist(), chosen.tolist(), strict=True):
        lo, hi = int(found.starts[word]), int(found.ends[word])
        text = data[lo:hi].tobytes().decode("utf-8", "replace")
        if text not in memo:
            if len(memo) > 200_000:
                memo.clear()
            memo[text] = trie.match(text)
        match = memo[text]
        if match is None:
            continue
        left = data[max(int(at[row]), lo - WINDOW) : lo].tobytes().decode("utf-8", "ignore")
        right = data[hi : min(int(at[row + 1]), hi + WINDOW)].tobytes().decode("utf-8", "ignore")
        quoted = bool(
            QUOTES.search(left) and QUOTES.search(right) or REPORTING.search(left)
        )
        out[row, 3 if quoted else 2 if match[1] else 0] += 1
        if not quoted:
            out[row, 1] = 1
            out[row, 4] += before[0] == row and word - before[1] <= 12
        before = (row, word)
        terms[row].append(match[0])
    out[:, [0, 2, 3, 4]] = np.log1p(out[:, [0, 2, 3, 4]])
    return out, terms


def fit_logistic(rows: np.ndarray, label: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression, the last for the constant, by Newton steps."""
    x = np.hstack([rows, np.ones((len(rows), 1))])
    beta = np.zeros(x.shape[1])
    ridge = np.full(len(beta), 0.05)
    ridge[-1] = 1e-3
    for _ in range(50):
        chance = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weight * (label - chance)) - ridge * beta
        curve = (x * (weight * chance * (1 - chance))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(curve, slope)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def _terms_of(word: str) -> list[str]:
    """A word of any length as a term, and its stems, marked by a final asterisk."""
    return [word, *(word[:n] + "*" for n in STEMS if len(word) >= n)]


def _pieces(text: str) -> set[str]:
    return {term for word in set(WORD.findall(text.lower())) for term in _terms_of(word)}


def learn(chosen: DataFrame) -> list[tuple[str, bool]]:
    """Terms of a bounded table of distinct labelled texts (label, text)."""

    def count(wanted=None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                times: Counter[str] = Counter()
                for text in batch.column("text").to_pylist():
                    own = _pieces(text or "")
                    times.update(own if wanted is None else own & wanted.value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(times), pa.string()), pa.array(list(times.values()), pa.int64())],
                    ["term", "texts"],
                )

        return run

    context = chosen.sparkSession.sparkContext
    sizes = {r[0]: r[1] for r in chosen.groupBy("label").count().collect()}
    if not sizes.get(1):
        return []
    toxic, clean = chosen.filter("label = 1"), chosen.filter("label = 0")
    least = max(MIN_DOCS, MIN_SHARE * sizes[1])
    schema = "term string, texts long"
    often = (
        toxic.mapInArrow(count(), schema)
        .groupBy("term")
        .agg(F.sum("texts").alias("texts"))
        .filter(F.col("texts") >= least)
    ).toArrow()
    in_toxic = dict(zip(often["term"].to_pylist(), often["texts"].to_pylist(), strict=True))
    wanted = context.broadcast(frozenset(in_toxic))
    rest = clean.mapInArrow(count(wanted), schema).groupBy("term").agg(F.sum("texts").alias("texts"))
    rest = rest.toArrow()
    in_clean = dict(zip(rest["term"].to_pylist(), rest["texts"].to_pylist(), strict=True))
    share = (sizes.get(0, 0) + 1) / (sizes[1] + 1)
    good = {t for t, n in in_toxic.items() if n * share >= MIN_RATIO * (in_clean.get(t, 0) + 0.5)}
    kept = context.broadcast(frozenset(good))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[str, str, str]] = []
            for text in batch.column("text").to_pylist():
                words = ["", *WORD.findall((text or "").lower()), ""]
                own: dict[str, tuple[str, str]] = {}
                for left, word, right in zip(words, words[1:], words[2:], strict=False):
                    for term in _terms_of(word):
                        if term in kept.value:
                            own.setdefault(term, (left, right))
                found += [(term, *sides) for term, sides in own.items()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.string()) for x in (zip(*found) if found else ([], [], []))],
                ["term", "before", "after"],
            )

    around = store(
        toxic.mapInArrow(contexts, "term string, before string, after string")
        .groupBy("term", "before", "after")
        .agg(F.count(F.lit(1)).alias("texts"))
    )
    main = around.groupBy("term").agg(
        F.sum("texts").alias("total"),
        F.max(F.struct("texts", "before", "after")).alias("main"),
    )
    same = [F.col(x) == F.col(f"main.{x}") for x in ("before", "after")]
    copied = (F.col("main.texts") * 2 > F.col("total")) & (same[0] != same[1])
    found = (
        around.join(main, "term")
        .groupBy("term")
        .agg(F.max("total").alias("texts"), F.count_if(~copied).alias("contexts"))
        .filter(F.col("contexts") >= MIN_DOCS)
        .toArrow()
    )
    return _select(dict(zip(found["term"].to_pylist(), found["texts"].to_pylist(), strict=True)))


def _select(texts: dict[str, int]) -> list[tuple[str, bool]]:
    """Words and stems to keep: a stem if it says more than what it begins, which then goes."""

    def begins(term: str) -> list[str]:
        word = term.rstrip("*")
        return [word[:n] + "*" for n in STEMS if n <= len(word) and word[:n] + "*" != term]

    below: dict[str, int] = {}
    for term, n in texts.items():
        for stem in begins(term):
            below[stem] = max(n, below.get(stem, 0))
    stems = {t for t, n in texts.items() if t.endswith("*") and n >= STEM_GAIN * below.get(t, 0)}
    words = {t for t in texts if not t.endswith("*")}
    kept = sorted(t for t in words | stems if not stems.intersection(begins(t)))
    return [(t.rstrip("*"), t.endswith("*")) for t in kept]


def _sample(texts: DataFrame, max_rows: int) -> tuple[DataFrame, dict[int, float]]:
    """At most about ``max_rows`` texts of each label by their hash, and the share that was kept."""
    sizes = {r[0]: r[1] for r in texts.groupBy("label").count().collect()}
    keep = {k: min(1.0, max_rows * 0.98 / n) for k, n in sizes.items()}
    share = F.lit(0.0)
    for k, x in keep.items():
        share = F.when(F.col("label") == k, F.lit(x)).otherwise(share)
    return texts.filter(F.pmod(F.xxhash64("hash"), F.lit(10**6)) < share * 10**6), keep


def score(
    docs: DataFrame,
    labels: DataFrame,
    train: Column,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    max_rows: int = MAX_ROWS,
) -> DataFrame:
    """doc_id, score, predicted and terms of every row; ``train`` tells the labels to learn from.

    Texts are read once to hash them, once to take the sample and once to be scored, and
    are not shuffled: hashes find the distinct labelled texts, of which the sample's are
    broadcast with one id each (at most ``max_rows`` of each label).
    """
    context = docs.sparkSession.sparkContext
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    known = labels.filter(F.coalesce(train, F.lit(False)) & F.col(label).isin(0, 1)).select(
        F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label")
    )
    hashed = rows.withColumn("hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    texts = store(
        store(hashed.select("id", "hash"))
        .join(store(known), "id")
        .groupBy("hash", "label")
        .agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("times"))
    )
    picked, share = _sample(texts, max_rows)
    chosen = store(
        hashed.join(F.broadcast(picked), ["id", "hash"])
        .select("hash", "label", "times", "text")
        .dropDuplicates(["hash", "label"])
    )
    shared = context.broadcast(lexicon(learn(chosen)))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, trie, memo = shared.value, Trie(shared.value.terms), {}
        for batch in batches:
            for part in tokens.blocks(batch, "text"):
                found, _ = hits(part.column("text"), known, trie, memo)
                yield pa.RecordBatch.from_arrays(
                    [part.column("hash"), part.column("label"), part.column("times"),
                     tokens.lists(list(found), pa.float64())], ["hash", "label", "times", "found"],
                )

    kind = rows.schema["id"].dataType.simpleString()
    table = chosen.mapInArrow(features, "hash long, label int, times long, found array<double>")
    table = table.orderBy("hash", "label").toArrow()
    label_of = table["label"].to_numpy().astype(float)
    found = table["found"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    weight = table["times"].to_numpy() / np.array([share[int(x)] for x in label_of])
    beta = fit_logistic(found.reshape(-1, len(FEATURES)), label_of, weight)
    if not len(label_of):
        beta = np.zeros(len(FEATURES) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, trie, memo = shared.value, Trie(shared.value.terms), {}
        for batch in batches:
            for part in tokens.blocks(batch, "text"):
                found, terms = hits(part.column("text"), known, trie, memo)
                margin = np.clip(found @ beta[:-1] + beta[-1], -30, 30)
                chance = 1 / (1 + np.exp(-margin))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(chance),
                     pa.array((chance >= 0.5).astype(np.int32)),
                     pa.array(terms, pa.list_(pa.string()))],
                    [doc_id, "score", "predicted", "terms"],
                )

    return rows.mapInArrow(
        run, f"{doc_id} {kind}, score double, predicted int, terms array<string>"
    )


def clean_rows(
    docs: DataFrame, labels: DataFrame, train: Column, doc_id: str = "doc_id", **settings
) -> DataFrame:
    """The documents that are not predicted toxic, with their columns."""
    bad = score(docs, labels, train, doc_id, **settings).filter("predicted = 1")
    return docs.join(
        bad.select(F.col(doc_id).alias("__bad")).distinct(),
        F.col(doc_id).eqNullSafe(F.col("__bad")),
        "left_anti",
    )
