"""Runs against a search of all periods, and the query against its contract in plain Python."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from sitelens.llm import periodic_runs
from sitelens.llm.periodic_runs import Names, Wavelet, find_runs, run_digest, runs_of
from sitelens.llm.queries import op13_periodic_runs


def every_run(words, least=12):
    """(start, length, period) of all runs, by trying all periods."""
    w = np.array(words)
    out = {}
    for q in range(1, len(w) // 2 + 1):
        same = np.concatenate([[False], w[q:] == w[:-q], [False]])
        begin = np.flatnonzero(same[1:] & ~same[:-1])
        end = np.flatnonzero(same[:-1] & ~same[1:]) + q
        for s, e in zip(begin.tolist(), end.tolist(), strict=True):
            if e - s >= max(least, 2 * q):
                out.setdefault((s, e), q)
    return sorted((s, e - s, q) for (s, e), q in out.items())


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def made_documents(draw):
    for _ in range(draw.randint(1, 4)):
        n, kind = draw.randint(0, 150), draw.randrange(5)
        words = [draw.randrange(draw.choice([1, 2, 3, 6])) for _ in range(n)]
        if kind == 1 and n:
            words = [words[i % draw.choice([1, 3, min(n, 17), min(n, 40)])] for i in range(n)]
        elif kind == 2:
            words = fibonacci(n)
        elif kind == 3:
            words = (([0] * draw.randint(1, 30) + [1] * draw.randint(0, 3)) * 20)[:n]
            words[n // 2 : n // 2] = [2] * draw.randint(0, 1)
        elif kind == 4 and n:
            start, period = draw.randrange(n), draw.randint(1, 40)
            words = [w if i < start else words[start + (i - start) % min(period, n - start)] for i, w in enumerate(words)]
        yield words


@pytest.mark.parametrize("seed", range(8))
def test_equals_every_period(seed):
    draw = random.Random(seed)
    for _ in range(80):
        docs = list(made_documents(draw))
        least = draw.choice([12, 12, 20])
        first = np.cumsum([0, *map(len, docs)])
        words = np.array([w for doc in docs for w in doc], np.int64)
        got = [tuple(r) for r in runs_of(words, first, least).tolist()]
        assert got == [(d, *r) for d, doc in enumerate(docs) for r in every_run(doc, least)]


def test_candidates_stay_few(monkeypatch):
    """One word for ever, and long stretches of one word, ask for few comparisons."""
    compared = []
    behind = Names.behind
    monkeypatch.setattr(Names, "behind", lambda self, i, j: compared.append(len(i)) or behind(self, i, j))
    for words, most in (([0] * 50_000, 1.5), (([0] * 100 + [1]) * 500, 12)):
        compared.clear()
        found = runs_of(np.array(words, np.int64), np.array([0, len(words)]))
        assert len(found) >= 1 and sum(compared) <= most * len(words)


def test_range_successor():
    draw = random.Random(5)
    values = np.array(draw.sample(range(300), 120))
    tree = Wavelet(values, 300)
    ask = [(*sorted(draw.choices(range(121), k=2)), draw.randint(0, 700)) for _ in range(500)]
    low, high, bound = np.array(ask).T
    want = [min((v for v in values[lo:hi].tolist() if v >= x), default=-1) for lo, hi, x in ask]
    assert tree.successor(low, high, bound).tolist() == want


def test_short_runs_are_refused():
    with pytest.raises(ValueError):
        runs_of(np.zeros(5, np.int64), np.array([0, 5]), least=6)


def test_rows(spark):
    twelve = " ".join(["a"] * 12)
    rows = [
        (1, None, 0), (2, "", 0), (3, "\n\t ", 0), (4, "a " * 11, 0), (5, f"x  {twelve}\ny", 0), (5, f"x  {twelve}\ny", 0),
        (None, "b a A a " * 3 + "b", 0), (7, "é è\u00a0" * 6, 0), (8, "w " * 30_000, 0),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in find_runs(docs).collect()]
    assert sorted(got, key=str) == sorted(
        [
            (1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""),
            (4, 11, [], " ".join("a" * 11)),
            *[(5, 14, [(1, 12, 1)], "x a y")] * 2,
            (None, 13, [(0, 13, 4)], "b a A a"),
            (7, 7, [], "é è\u00a0é è\u00a0é è\u00a0é è\u00a0é è\u00a0é è\u00a0"),
            (8, 30_000, [(0, 30_000, 1)], "w"),
        ],
        key=str,
    )
    assert find_runs(docs.limit(0)).count() == 0
    longest = run_digest(find_runs(docs.filter("doc_id = 1"))).first()
    assert longest[1:6] == (0, None, None, None, None)
    assert longest.runs_sha256 == longest.collapsed_sha256 == hashlib.sha256(b"").hexdigest()


def by_contract(doc_id, text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n > 0:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    number = {w: k for k, w in enumerate(dict.fromkeys(words))}
    runs = every_run([number[w] for w in words])
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
        sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)),
        sha(" ".join(w for i, w in enumerate(words) if i not in dropped)),
    )


def test_query_keeps_its_contract(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = op13_periodic_runs(spark, sf_dir)
    assert got.columns == [
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"
    ]
    want = [by_contract(*d) for d in docs]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert sum(w[1] for w in want) > 15
