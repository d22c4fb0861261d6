"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_names():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf_dir, name):
    _, rows, problem = compare(spark, con, sf_dir, QUERIES[name], ORACLE.get(name))
    assert problem is None and rows > 0


def test_entry(spark):
    assert "domain" in entry.entry(spark).columns


def test_streams_read_tables_of_many_files(spark, con, sf_dir, tmp_path):
    """A table is one file, or a folder of them."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    pages.repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    name = "pages_stream"
    _, rows, problem = compare(spark, con, str(tmp_path), QUERIES[name], ORACLE[name])
    assert problem is None and rows == pages.count()


def test_ledger_files_are_written_by_many_tasks(spark, sf_dir):
    """The entries have few bytes, but a file each."""
    found = QUERIES["ledger_scan"](spark, sf_dir)
    paths = {tuple(f.rsplit("/", 4)[-1].split("-")[:2]) for f in found.inputFiles()}
    assert len(paths) > 1
