"""Quality and toxicity: parts against plain versions, accuracy on held-out rows."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sitelens.llm import quality, toxicity
from sitelens.llm.common import remainder

DOCS = "doc_id long, text string, label int, found string, id string"
LABELS = "doc_id long, quality int, toxic int, text string"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(new[j] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def test_automaton_against_edit_distance():
    rng = random.Random(2)
    terms = [("abcab", False), ("abcac", False), ("bbb", False), ("caab", True)]
    trie = toxicity.Trie(terms)
    for _ in range(3000):
        word = "".join(rng.choices("abc", k=rng.randrange(1, 9)))
        near = [(distance(word, t), t) for t, stem in terms
                if not stem and (word == t or len(t) >= 5 and distance(word, t) <= 1)]
        near += [(0, t) for t, stem in terms if stem and word.startswith(t)]
        got = trie.match(word)
        assert (got is None) == (not near), (word, got, near)
        if near:
            assert got[1] == min(near)[0]


def test_misspellings_survive_the_hash_filter():
    known = toxicity.lexicon([("wörthless", False), ("scum", False), ("lowei", True)])
    trie = toxicity.Trie(known.terms)
    texts = ["wörthles", "vörthless", "WÖRTHLESS", "wörthlesss", "wörthxess", "scum", "scumm",
             "loweient", "lowient", "clean words only", None]
    found, terms = toxicity.hits(pa.array(texts), known, trie, {})
    assert [len(t) for t in terms] == [1, 1, 1, 1, 1, 1, 0, 1, 0, 0, 0]


def test_quotation_is_told_from_abuse():
    known = toxicity.lexicon([("moron", False)])
    trie = toxicity.Trie(known.terms)
    texts = ["you moron go away", 'the text has "moron" in quotes', "she said moron twice"]
    found, _ = toxicity.hits(pa.array(texts), known, trie, {})
    assert (found[:, 0] > 0).tolist() == [True, False, False]
    assert (found[:, 3] > 0).tolist() == [False, True, True]


def made(n=400):
    rng = random.Random(4)
    words = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in ("ld", "nt", "rm", "st")]
    docs, labels = [], []
    for i in range(n):
        text = rng.choices(words, k=rng.randrange(5, 60))
        bad, ugly = rng.random() < 0.3, rng.random() < 0.3
        if bad:
            text[rng.randrange(len(text))] = rng.choice(["wretched", "villain", "scoundrel"])
        text = " ".join(text)
        docs.append((i, text.upper().replace(" ", "!! ") if ugly else text, 0, "", ""))
        labels.append((i, int(not ugly), int(bad), ""))
    odd = [(n, None), (n + 1, ""), (n + 2, "vilain " * 30_000), (None, "dald"), (n + 3, "bent"), (n + 3, "bent")]
    return docs + [(*x, 0, "", "") for x in odd], labels + [(n, 1, None, ""), (9999, 0, 1, ""), (1, 5, 5, "")]


def outcome(spark, run, docs, labels, column, split):
    found = run.score(
        spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS), split, label=column
    )
    rows = found.collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == int(r.score >= 0.5) for r in rows)
    return {r.doc_id: r for r in rows}


def test_quality_of_made_rows(spark):
    docs, labels = made()
    got = outcome(spark, quality, docs, labels, "quality", remainder(3) != 1)
    right = [got[i].predicted == q for i, q, *_ in labels[:400]]
    assert np.mean(right) > 0.97


def test_toxicity_of_made_rows(spark):
    docs, labels = made()
    got = outcome(spark, toxicity, docs, labels, "toxic", remainder(5) != 0)
    assert all(got[i].predicted == t for i, _, t, _ in labels[:400])
    assert got[402].predicted == 1 and got[402].terms[0] == "villain"
    assert got[400].predicted == got[401].predicted == 0


def test_short_insults_are_learned(spark):
    """A three-letter word in a third of the labelled texts, among short words of all texts."""
    rng = random.Random(8)
    words = ["the", "of", "to", "a", "and", *(f"{a}{b}" for a in "bdfgklm" for b in ("oat", "ine", "ust", "ond"))]
    docs, labels = [], []
    for i in range(600):
        text = rng.choices(words, k=rng.randrange(5, 40))
        if i % 3 == 0:
            text[rng.randrange(len(text))] = "zog"
        docs.append((i, " ".join(text), 0, "", ""))
        labels.append((i, 1, int(i % 3 == 0), ""))
    got = outcome(spark, toxicity, docs, labels, "toxic", remainder(5) != 0)
    assert all(got[i].predicted == (i % 3 == 0) for i in range(600))
    assert {t for r in got.values() for t in r.terms} == {"zog"}


@pytest.mark.parametrize("near", [False, True])
def test_copies_of_a_toxic_text_keep_all_insults(spark, near):
    docs, labels = made(600)
    bad = [i for i, _, t, _ in labels[:600] if t]
    text = docs[bad[0]][1].split() + ["wretched", "once", "villain", "twice", "scoundrel", "thrice"]
    texts = []
    for k in range(9 * len(bad)):  # 90 % of the toxic labels
        own = list(text)
        if near:
            own[k % (len(text) - 6)] = f"{zlib.crc32(str(k).encode()):08x}"
        texts.append(" ".join(own))
    docs += [(10_000 + k, x, 0, "", "") for k, x in enumerate(texts)]
    labels += [(10_000 + k, 1, 1, "") for k in range(len(texts))]
    got = outcome(spark, toxicity, docs, labels, "toxic", remainder(5) != 0)
    assert all(got[i].predicted == t for i, _, t, _ in labels[:600] + labels[-len(texts) :])
    found = {term for r in got.values() for term in r.terms}
    assert found <= {"wretched", "villain", "scoundrel", *(w[:n] for n in range(4, 9)
                     for w in ("wretched", "villain", "scoundrel"))}


def test_without_labels_and_empty_tables(spark):
    docs, labels = made(20)
    for run, column in ((quality, "quality"), (toxicity, "toxic")):
        assert {r.score for r in outcome(spark, run, docs, [], column, F.lit(True)).values()} == {0.5}
        assert outcome(spark, run, [], labels, column, F.lit(True)) == {}


def test_clean_rows_keep_their_columns(spark):
    docs, labels = made()
    table = spark.createDataFrame(docs, DOCS)
    kept = toxicity.clean_rows(table, spark.createDataFrame(labels, LABELS), remainder(5) != 0)
    toxic = {i for i, _, t, _ in labels[:400] if t}
    assert kept.columns == table.columns
    assert {r.doc_id for r in kept.collect()} == {d[0] for d in docs} - toxic - {402}


def test_trees_equal_a_walk_node_by_node():
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(500, len(quality.STATISTICS))).astype(np.float32)
    label = ((rows[:, 0] > 0) ^ (rows[:, 1] > 0.3)).astype(float)
    trees = quality.grow(rows, label, trees=20)
    for row, margin in zip(rows[:50], trees.margin(rows)[:50], strict=True):
        total = trees.base
        for node in trees.roots:
            while trees.left[node] != node:
                low = row[trees.feature[node]] <= trees.threshold[node]
                node = trees.left[node] if low else trees.right[node]
            total += trees.value[node]
        assert np.isclose(total, margin)
    assert ((trees.score(rows) >= 0.5) == label).mean() > 0.95


def test_statistics_of_known_texts():
    rows = quality.statistics(pa.array(["ab ab\nCD ef.", None, "x"]))
    by = dict(zip(quality.STATISTICS, rows.T, strict=True))
    assert np.allclose(by["log_words"], np.log1p([4, 0, 1]))
    assert np.allclose(by["distinct_words"], [0.75, 0, 1])
    assert np.allclose(by["repeats"], [0.25, 0, 0])
    assert np.allclose(by["upper_words"], [0.25, 0, 0])
    assert np.allclose(by["log_lines"], np.log1p([2, 1, 1]))
    assert np.allclose(by["distinct_lines"], [1, 0, 1])


def test_held_out_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = quality.score(docs, labels, remainder(3) != 1)
    held = found.join(labels, "doc_id").filter(remainder(3) == 1)
    assert held.agg(F.avg((F.col("quality") == F.col("predicted")).cast("int"))).first()[0] > 0.9
