"""Joins that keep hot keys apart, and lineage cuts that survive lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key with more rows than this is spread over SALTS join tasks.
HOT_ROWS = 1_000_000
SALTS = 64
# No more than this many keys can each hold 1 / MAX_HOT_KEYS of the rows.
MAX_HOT_KEYS = 1000


def checkpoint_dir(df: DataFrame) -> str:
    """The reliable checkpoint folder; a temporary one only in local mode."""
    spark = df.sparkSession
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("Set spark.checkpoint.dir to a folder all executors share.")
        folder = tempfile.mkdtemp(prefix="sitelens-checkpoint-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and read it back."""
    checkpoint_dir(df)
    return df.checkpoint(eager=True)


def stored_by(df: DataFrame, key: str | Sequence[str], deal: bool = False) -> DataFrame:
    """Write ``df`` as a Parquet table bucketed by ``key`` and read it back.

    Joins and groups on the key then need no exchange of this side, and reads take
    only the columns they use. ``deal`` moves the rows to their buckets first; leave
    it out when a join or group on the key has just done that. The files lie beside
    the checkpoints, so lost executors cost a read; ``drop_stored`` deletes them.
    """
    spark = df.sparkSession
    keys = [key] if isinstance(key, str) else list(key)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"sitelens_{uuid.uuid4().hex}"
    path = f"{checkpoint_dir(df)}/{name}"
    rows = df.repartition(buckets, *keys) if deal else df
    (
        rows.write.format("parquet")
        .option("path", path)
        .bucketBy(buckets, *keys)
        .sortBy(*keys)
        .saveAsTable(name)
    )
    table = spark.table(name)
    table.stored_as = (name, path)
    return table


def drop_stored(table: DataFrame) -> None:
    """Delete a table that ``stored_by`` has written, once nothing reads it any more."""
    spark = table.sparkSession
    name, path = table.stored_as
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def hot_keys(
    df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS, known_rows: int | None = None
) -> DataFrame:
    """All keys of ``df`` with more than ``hot_rows`` rows and 1 / MAX_HOT_KEYS of the rows.

    There are fewer than MAX_HOT_KEYS such keys, whatever the table, so nothing has to
    be cut off. A key below that share is a small part of every task's work.
    """
    total = df.count() if known_rows is None else known_rows
    least = max(hot_rows, total // MAX_HOT_KEYS)
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("__n"))
        .filter(F.col("__n") > least)
        .select(*keys, F.lit(True).alias("__hot"))
    )


def salted_join(
    many: DataFrame,
    few: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    hot_rows: int = HOT_ROWS,
    salts: int = SALTS,
    known_rows: int | None = None,
) -> DataFrame:
    """Join ``many`` (any number of rows per key) with ``few`` (few rows per key).

    Rows of hot keys are spread by a salt and their ``few`` rows repeated once per
    salt; all other keys join as usual. The list of hot keys is broadcast: it has
    fewer than MAX_HOT_KEYS rows by its definition. With ``how="left"`` rows of ``many`` are kept. When
    the caller knows ``many`` to be small enough, no key can be hot.
    """
    keys = list(keys)
    if known_rows is not None and known_rows <= hot_rows:
        return many.join(few, keys, how)
    hot = F.broadcast(hot_keys(many, keys, hot_rows, known_rows))
    spread = F.pmod(F.xxhash64(*many.columns), F.lit(salts)).cast("int")
    left = many.join(hot, keys, "left").withColumn(
        "__salt", F.when(F.col("__hot"), spread).otherwise(F.lit(0))
    )
    right = few.join(hot, keys, "left").withColumn(
        "__salt",
        F.explode(
            F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(
                F.array(F.lit(0))
            )
        ),
    )
    return left.drop("__hot").join(right.drop("__hot"), [*keys, "__salt"], how).drop("__salt")
