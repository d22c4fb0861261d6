import random
from collections import defaultdict

import numpy as np

from sitelens.llm import packing

SCHEMA = "doc_id long, text string, source string, cluster string, shard int, piece int"


def plain(sizes, sources, clusters, capacity):
    """Every bin is looked at; the tightest compatible one with the least room wins."""
    bins, out = [], []
    for n, s, c in zip(sizes, sources, clusters, strict=True):
        fits = [(b["room"], i) for i, b in enumerate(bins)
                if b["room"] >= n and (s < 0 or s not in b["s"]) and (c < 0 or c not in b["c"])]
        if not fits:
            bins.append({"room": capacity, "s": set(), "c": set()})
            out.append((len(bins) - 1, capacity))
        else:
            room, i = min(fits)
            out.append((i, room))
        b = bins[out[-1][0]]
        b["room"] -= n
        b["s"].add(s)
        b["c"].add(c)
    return [room for _, room in out], len(bins)


def test_always_the_tightest_compatible_bin():
    rng = random.Random(6)
    for _ in range(60):
        count = rng.randrange(1, 400)
        sizes = sorted((rng.randrange(1, 100) for _ in range(count)), reverse=True)
        sources = [rng.randrange(-1, 90) for _ in range(count)]
        clusters = [rng.randrange(-1, 4) for _ in range(count)]
        got = packing.best_fit(np.array(sizes), np.array(sources), np.array(clusters), 100)
        room, used = defaultdict(lambda: 100), defaultdict(set)
        for n, s, c, b in zip(sizes, sources, clusters, got.tolist(), strict=True):
            assert room[b] >= n and ("s", s) not in used[b] and ("c", c) not in used[b]
            others = [x for x in room if room[x] >= n and (s < 0 or ("s", s) not in used[x])
                      and (c < 0 or ("c", c) not in used[x])]
            assert room[b] == min((room[x] for x in others), default=100)
            room[b] -= n
            used[b] |= {("s", s)} - {("s", -1)} | {("c", c)} - {("c", -1)}


def test_pieces_cover_texts_and_conflicts_hold(spark):
    rng = random.Random(8)
    rows = [(i, "w " * rng.randrange(1, 300), f"s{rng.choice([0, 0, 1, 2, 3])}") for i in range(200)]
    rows += [(i, "copy of one text", f"t{i}") for i in range(300, 320)]
    rows += [(400, None, "s1"), (401, "", None), (402, " \n", "s1"), (403, "x " * 5000, "s2"),
             (404, "no source", None), (404, "no source", None), (None, "no id", "s3")]
    docs = spark.createDataFrame([(*r, "c", 1, 1) for r in rows], SCHEMA)
    found = packing.pack(docs, capacity=500, shard_pieces=60).collect()
    words = defaultdict(int)
    for r in found:
        words[r.doc_id] += r.n_words
    assert words[403] == 5000 and words[400] == words[401] == words[402] == 0
    assert sum(words.values()) == sum(len((t or "").split()) for _, t, _ in rows)
    source = {i: s for i, _, s in rows}
    bins = defaultdict(list)
    for r in found:
        if r.n_words:
            bins[r.shard, r.bin].append(r)
        else:
            assert r.bin is None
    for own in bins.values():
        named = [source[r.doc_id] for r in own if source[r.doc_id]]
        assert len(named) == len(set(named)) and sum(r.n_words for r in own) <= 500
        assert sum(300 <= (r.doc_id or 0) < 320 for r in own) <= 1
        assert {r.bin_room for r in own} == {500 - sum(r.n_words for r in own)}


def test_named_cluster_and_empty_table(spark):
    rows = [(i, "a b", f"s{i}", "same", 1, 1) for i in range(5)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = packing.pack(docs, cluster="cluster").collect()
    assert len({(r.shard, r.bin) for r in found}) == 5
    assert packing.pack(docs.limit(0)).count() == 0


def test_documents_fill_bins(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = packing.pack(docs).toPandas()
    used = found[found.n_words > 0]
    assert used.groupby(["shard", "bin"])["n_words"].sum().max() <= packing.CAPACITY
    assert set(found["doc_id"]) == {r.doc_id for r in docs.select("doc_id").collect()}
