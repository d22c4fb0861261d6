"""Registered queries against DuckDB, and the pipeline against its stages on plain data."""

import hashlib
import sys

import duckdb
import pytest

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

import __spark_entry__  # noqa: E402
import corpus_pipeline  # noqa: E402
from sitelens.llm import queries  # noqa: E402
from tests.llm.test_jaccard_join import brute  # noqa: E402


def test_every_operator_has_one_query():
    names = list(__spark_entry__.queries())
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names and len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracle(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    want = con.execute(queries.ORACLE[name]).df()
    got = __spark_entry__.queries()[name](spark, sf_dir).toPandas()[list(want.columns)]
    as_rows = lambda df: sorted(map(str, df.astype(str).values.tolist()))
    assert as_rows(got) == as_rows(want)


COLUMNS = {
    "op2_language": ["doc_id", "held_out", "lang_pred", "score"],
    "op3_quality": ["doc_id", "held_out", "score", "predicted"],
    "op4_jaccard_join": ["doc_id", "n_shingles", "component_id"],
    "op10_toxicity": ["doc_id", "held_out", "score", "predicted"],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_contract_columns(spark, sf_dir, name):
    found = __spark_entry__.queries()[name](spark, sf_dir)
    assert found.columns[: len(COLUMNS[name])] == COLUMNS[name]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert found.count() == docs.count()


def test_pipeline_stages_take_effect(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, [{r.doc_id: r.text for r in docs.collect()}]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        if name != "packing":
            assert docs.columns == columns
            assert docs.count() == docs.select("doc_id").distinct().count()
            seen.append({r.doc_id: r.text for r in docs.collect()})
    start, clean, distinct, joined, final = seen
    flagged = queries.QUERIES["op10_toxicity"](spark, sf_dir).filter("predicted = 1")
    assert set(start) - set(clean) == {r.doc_id for r in flagged.collect()}
    keep: dict = {}
    for i, text in clean.items():
        sha = hashlib.sha256((text or "").encode()).digest()
        keep[sha] = max(i, keep.get(sha, i))
    assert set(distinct) == set(keep.values())
    classes = brute(list(distinct.items()), 80, 5)
    assert set(joined) == {component for _, _, component, _ in classes}
    leaked = {r.doc_id for r in queries.QUERIES["op1_decontamination"](spark, sf_dir).collect()}
    assert set(final) == set(joined) - leaked
    assert {r.doc_id for r in docs.collect()} == set(final)
