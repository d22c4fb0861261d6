import hashlib

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from sitelens.llm import exact_dedup


@given(st.lists(st.integers(0, 2**64 - 1), max_size=200, unique=True))
def test_rice_round_trip(values):
    values = np.array(sorted(values), np.uint64)
    assert (exact_dedup.rice_decode(exact_dedup.rice_encode(values)) == values).all()


def groups(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, id int, fp string, sha string")
    return exact_dedup.text_groups(docs), exact_dedup.distinct_rows(docs), docs


def test_groups_and_edge_cases(spark):
    long = "long " * 100_000
    rows = [
        (1, "a"), (2, "a"), (3, "A"), (4, None), (5, ""), (6, long), (7, long), (8, "b "),
        (9, "b"), (10, "c"), (10, "c"), (None, "a"), (None, "d"), (11, "ü"), (12, "ü"),
    ]
    found, kept, docs = groups(spark, [(*r, 1, "f", "s") for r in rows])
    got = {(r.doc_id, r.text_sha256): r for r in found.collect()}
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert found.count() == len(rows)
    assert got[1, sha("a")].keep_id == 2 and got[1, sha("a")].group_size == 3
    assert not got[1, sha("a")].kept and got[2, sha("a")].kept
    assert not got[None, sha("a")].kept and got[None, sha("d")].kept
    assert got[4, sha("")].keep_id == 5 and got[5, sha("")].group_size == 2
    assert got[6, sha(long)].keep_id == 7
    assert got[8, sha("b ")].group_size == 1 and got[3, sha("A")].kept
    assert got[10, sha("c")].group_size == 2 and got[10, sha("c")].kept
    assert got[11, sha("ü")].group_size == 1
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i or 0 for i in ids) == [0, 2, 3, 5, 7, 8, 9, 10, 11, 12]


def test_empty_table(spark):
    found, kept, _ = groups(spark, [])
    assert found.count() == 0 and kept.count() == 0


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    by_text: dict = {}
    for r in docs.collect():
        by_text.setdefault(r.text or "", []).append(r.doc_id)
    want = {i: (max(own), len(own)) for own in by_text.values() for i in own}
    got = exact_dedup.text_groups(docs).collect()
    assert {r.doc_id: (r.keep_id, r.group_size) for r in got} == want
