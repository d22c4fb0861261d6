import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitelens.llm import language
from sitelens.llm.common import remainder

WORDS = {
    "en": "the of and to with that from this have which".split(),
    "de": "der die und das nicht für über schön werden größe".split(),
    "ru": "что как это для они если только после слово время".split(),
}


def rows(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(sorted(WORDS))
        out.append((i, " ".join(rng.choices(WORDS[lang], k=rng.randrange(3, 40))), lang, "x"))
    return out


SCHEMA = "doc_id long, text string, lang string, score string"


def test_accuracy_and_edge_cases(spark):
    made = rows(300)
    odd = [(1000, None, "en", ""), (1001, "", "en", ""), (1002, "12 %$", "de", ""),
           (1003, "und der " * 40_000, None, ""), (None, "the of and", "en", ""),
           (1004, "the of and to", None, ""), (1004, "the of and to", None, "")]
    docs = spark.createDataFrame(made + odd, SCHEMA)
    found = language.identify(docs, remainder(5) != 0).collect()
    assert len(found) == len(made) + len(odd)
    got = {r.doc_id: r for r in found}
    truth = {r[0]: r[2] for r in made}
    assert all(got[i].lang_pred == lang for i, lang in truth.items())
    assert all(0 <= r.score <= 1 for r in found)
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3
    assert got[1003].lang_pred == "de" and got[None].lang_pred == got[1004].lang_pred == "en"


def test_foreign_text_is_rejected(spark):
    made = rows(300)
    docs = spark.createDataFrame([*made, (999, "zxqj wvvk qqxz jjkw " * 5, None, "")], SCHEMA)
    found = {r.doc_id: r.rejected for r in language.identify(docs, F.lit(True)).collect()}
    assert found[999] and sum(found.values()) <= 5


class Plain:
    """Interpolated Kneser-Ney over characters with dictionaries."""

    def __init__(self, texts, order):
        self.order, self.counts = order, [None] * (order + 1)
        self.counts[order] = Counter(g for t in texts for g in self.grams(t))
        for n in range(order, 1, -1):
            self.counts[n - 1] = Counter(g[1:] for g in self.counts[n])
        self.letters = {g[-1] for g in self.counts[1]}

    def grams(self, text):
        line = re.sub(r"[^\W\d_]+", lambda m: m[0].lower(), text)
        line = re.sub(r"(?<=.)(?:[\W\d_])+", " ", re.sub(r"^[\W\d_]+", "", line))
        line = " " * (self.order - 1) + line.rstrip() + " "
        return [line[i : i + self.order] for i in range(len(line) - self.order + 1)] if line.strip() else []

    def chance(self, gram, alphabet):
        n = len(gram)
        if not n:
            return 1 / alphabet
        own = {g: c for g, c in self.counts[n].items() if g[:-1] == gram[:-1]}
        total = sum(own.values())
        if not total:
            return self.chance(gram[1:], alphabet)
        part = max(own.get(gram, 0) - 0.75, 0) / total
        return part + 0.75 * len(own) / total * self.chance(gram[1:], alphabet)


@pytest.mark.parametrize("entries", [10**9, 0])
def test_equals_a_plain_model(spark, entries):
    """By arrays and by joins: bits per character of each text under its best language."""
    rng = random.Random(3)
    made = [(i, t, lang, "x") for i, t, lang, _ in rows(60)]
    made += [(100 + i, "".join(rng.choices("αβγ漢字ßẞéÉ xX", k=rng.randrange(1, 30))), "zz", "x") for i in range(20)]
    odd = [(200, None, None, ""), (201, "", None, ""), (202, "q", None, ""), (203, "ВРЕМЯ, время!", None, ""),
           (204, "the  OF--and", None, ""), (205, "漢漢 字", None, ""), (205, "漢漢 字", None, "")]
    docs = spark.createDataFrame(made + odd, SCHEMA)
    found = language.identify(docs, F.lit(True), order=3, entries=entries).collect()
    plain = {lang: Plain([t for _, t, own, _ in made if own == lang], 3) for lang in [*WORDS, "zz"]}
    alphabet = len(set().union(*(p.letters for p in plain.values()))) + 1
    assert len(found) == len(made) + len(odd)
    texts = {r[0]: r[1] for r in made + odd}
    for r in found:
        grams = plain["zz"].grams(texts[r.doc_id] or "")
        if not grams:
            assert (r.lang_pred, r.score, r.entropy) == ("und", 0, None)
            continue
        bits = {k: -sum(math.log2(p.chance(g, alphabet)) for g in grams) / len(grams) for k, p in plain.items()}
        best = min(bits, key=bits.get)
        assert r.lang_pred == best and math.isclose(r.entropy, bits[best], rel_tol=1e-4), texts[r.doc_id]
        size = min(len(grams) - 1, 200)
        share = 1 / sum(2 ** ((bits[best] - b) * size) for b in bits.values())
        assert math.isclose(r.score, share, rel_tol=1e-3, abs_tol=1e-6)


def test_many_distinct_grams_do_not_meet(spark):
    """Over a million different 4-grams, each with its own key, and probabilities that sum to one."""
    points = np.random.default_rng(1).integers(0x4E00, 0x4E00 + 20_000, 1_300_000).astype(np.uint32)
    keys = language.gram_keys(points, 4)
    for n in range(2, 5):
        grams = np.lib.stride_tricks.sliding_window_view(points, n)
        exact = len(np.unique(np.ascontiguousarray(grams).view([("", points.dtype)] * n)))
        assert len(np.unique(keys[n][n - 1 :])) == exact
    assert exact > 1 << 20


def test_probabilities_sum_to_one(spark):
    docs = spark.createDataFrame(rows(100), SCHEMA)
    counts = language.count_grams(docs, "lang", "text", 3)
    letters = sorted({r.letter for r in counts.select("letter").distinct().collect()})
    model = language.fit(language.model_table(counts, 3), sorted(WORDS), len(letters) + 1, 3)
    unseen = ord("漢")
    for before in ([0, 0], [0, ord("t")], [ord("t"), ord("h")], [ord("ы"), ord("q")], [unseen, unseen]):
        points = np.array([x for letter in [*letters, unseen] for x in (*before, letter)], np.uint32)
        keys = language.gram_keys(points, 3)
        where = np.arange(2, len(points), 3)
        grams = dict(zip(language._columns(3), language._keys_at(keys, where, 3), strict=True))
        assert np.allclose(model.probability(grams).sum(0), 1, atol=1e-4)


def test_many_languages(spark):
    made = [(i, f"{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyz'[i // 100]}", f"l{i}", "") for i in range(300)]
    found = language.identify(spark.createDataFrame(made, SCHEMA), F.lit(True)).collect()
    assert all(r.lang_pred == f"l{r.doc_id}" for r in found)


def test_no_training_rows_and_empty_table(spark):
    docs = spark.createDataFrame(rows(5), SCHEMA)
    assert {r.lang_pred for r in language.identify(docs, F.lit(False)).collect()} == {"und"}
    empty = spark.createDataFrame([], SCHEMA)
    assert language.identify(empty, F.lit(True)).count() == 0


def test_held_out_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = language.identify(docs, remainder(5) != 0)
    right = found.join(docs, "doc_id").filter(remainder(5) == 0)
    assert right.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
