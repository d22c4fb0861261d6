"""Greedy string tiling against a plain version of the algorithm."""

import random
import re

from sitelens.llm import decontaminate


def plain_tiles(item, doc, width):
    """Longest match of unmarked words first, searched anew each time."""
    free_i, free_d, tiles = [True] * len(item), [True] * len(doc), []
    while True:
        best = (width - 1, 0, 0)
        for p in range(len(item)):
            for q in range(len(doc)):
                n = 0
                while (
                    p + n < len(item)
                    and q + n < len(doc)
                    and item[p + n] == doc[q + n]
                    and free_i[p + n]
                    and free_d[q + n]
                ):
                    n += 1
                if n > best[0]:
                    best = (n, p, q)
        n, p, q = best
        if n < width:
            return tiles
        tiles.append(best)
        free_i[p : p + n] = [False] * n
        free_d[q : q + n] = [False] * n


def places(item, doc, width):
    return [
        (p, q)
        for p in range(len(item) - width + 1)
        for q in range(len(doc) - width + 1)
        if item[p : p + width] == doc[q : q + width]
    ]


def test_tiles_cover_what_the_plain_search_covers():
    rng = random.Random(5)
    for _ in range(150):
        item = [rng.choice("abc") for _ in range(rng.randrange(4, 25))]
        doc = [rng.choice("abc") for _ in range(rng.randrange(4, 40))]
        got = decontaminate.tile(places(item, doc, 3), 3)
        want = plain_tiles(item, doc, 3)
        assert sorted(n for *_, n in got)[::-1][:1] == sorted(n for n, *_ in want)[::-1][:1]
        used_i = [p + k for p, _, n in got for k in range(n)]
        used_d = [q + k for _, q, n in got for k in range(n)]
        assert len(set(used_i)) == len(used_i) and len(set(used_d)) == len(used_d)
        assert all(item[p + k] == doc[q + k] for p, q, n in got for k in range(n))


ITEM = "The quick brown fox jumps. Over the lazy dog it goes again. Where no one has looked before."


def found(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string, item int, seed string, doc string")
    i = spark.createDataFrame(items, "item_id long, text string, doc string")
    return decontaminate.contaminated_pairs(d, i), d, i


def test_reordered_and_edge_cases(spark):
    moved = "Where no one has looked before: over the lazy dog it goes again - the quick brown fox jumps"
    docs = [
        (1, f"Some words first. {ITEM} Some after."),
        (2, moved.upper()),
        (3, "over the lazy dog it goes somewhere else entirely"),
        (4, None),
        (5, ""),
        (6, "x " * 50_000 + ITEM),
        (7, ITEM),
        (7, ITEM),
        (None, ITEM),
        (8, "one two three four"),
    ]
    items = [(10, ITEM, "z"), (10, ITEM, "z"), (11, None, "z"), (12, "one two three four", "z")]
    pairs, d, i = found(spark, [(*r, 1, "s", "t") for r in docs], items)
    rows = pairs.collect()
    assert sorted((r.doc_id or 0, r.item_id) for r in rows) == [
        (0, 10), (1, 10), (2, 10), (6, 10), (7, 10)]
    by = {r.doc_id: r for r in rows}
    assert by[1].coverage == 1.0 and len(by[1].tile_starts) == 1
    assert by[2].coverage == 1.0 and len(by[2].tile_starts) == 3
    assert by[6].tile_starts == [50_000]
    kept = decontaminate.decontaminate(d, i)
    assert kept.columns == d.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 8]


def test_copies_of_repetitive_items(spark):
    items = [(1, "word " * 20, "z"), (2, "one two three four five six " * 12, "z"), (3, ITEM, "z")]
    texts = [items[0][1], items[1][1], "before " + items[0][1] + "after", "word " * 9]
    rows = found(spark, [(i, t, 1, "s", "t") for i, t in enumerate(texts)], items)[0].collect()
    got = sorted((r.doc_id, r.item_id, r.coverage) for r in rows)
    assert got == [(0, 1, 1.0), (1, 2, 1.0), (2, 1, 1.0)]


def test_empty_tables(spark):
    assert found(spark, [], [(1, ITEM, "z")])[0].count() == 0
    assert found(spark, [(1, ITEM, 1, "s", "t")], [])[0].count() == 0


def test_documents_against_plain_search(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    word = re.compile(r"[A-Za-z0-9\u0080-\U0010ffff]+")
    wanted = set()
    texts = [(r.doc_id, word.findall(r.text)) for r in docs.collect()]
    lower = lambda w: [x.translate({c: c + 32 for c in range(65, 91)}) for x in w]
    for r in items.collect():
        item = lower(word.findall(r.text))
        seeds = {tuple(item[p : p + 5]) for p in range(len(item) - 4)}
        for doc_id, words in texts:
            doc = lower(words)
            if any(tuple(doc[q : q + 5]) in seeds for q in range(len(doc) - 4)):
                at = {q for q in range(len(doc) - 4) if tuple(doc[q : q + 5]) in seeds}
                near = sorted({k for q in at for k in range(q, q + 5)})
                covered = sum(n for n, *_ in plain_tiles(item, [doc[k] for k in near], 5))
                if covered >= 0.6 * len(item):
                    wanted.add((doc_id, r.item_id))
    got = decontaminate.contaminated_pairs(docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in got} == wanted and wanted
