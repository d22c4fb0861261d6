"""Run registered queries in Spark and their SQL in DuckDB and compare all rows.

    python tests/compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime
import decimal
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (float, decimal.Decimal)):
        return f"{float(value):.6f}"
    if isinstance(value, int):
        return str(value)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=lambda t: tuple("" if v is None else "=" + v for v in t))


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        if name.endswith(".parquet"):
            con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM read_parquet('{sf_dir}/{name}')")
    return con


def compare(spark, con, sf_dir, run, sql):
    """(seconds, rows, problem or None)."""
    started = time.time()
    df = run(spark, sf_dir)
    got = df.collect()
    seconds = time.time() - started
    if sql is None:
        return seconds, len(got), None
    cursor = con.execute(sql)
    names, want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    mine, have = rows_of(df.columns, got)
    if mine != names:
        return seconds, len(have), f"columns {mine} != {names}"
    if have == want:
        return seconds, len(have), None
    missing = [w for w in want if w not in set(have)][:2]
    extra = [h for h in have if h not in set(want)][:2]
    return seconds, len(have), f"rows {len(have)} vs {len(want)}\n  spark only {extra}\n  sql only   {missing}"


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in args or queries:
        try:
            seconds, n, problem = compare(spark, con, sf_dir, queries[name], oracle.get(name))
        except Exception as error:
            seconds, n, problem = 0.0, 0, f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        state = "ok" if problem is None else "BAD"
        print(f"{state:4}{name:24}{n:8} rows {seconds:7.2f}s {'' if name in oracle else '(rows only)'} {problem or ''}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
