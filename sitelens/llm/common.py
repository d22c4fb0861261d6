"""Tables written between steps, bounded bitmaps, and splits of labelled rows."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.operators.skew import checkpoint_dir

# Largest bitmap that tasks get: 2**28 bits, 32 MB, whatever the size of the input.
MAX_BITMAP_BITS = 28


def store(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet beside the checkpoints and read it back.

    Cuts the lineage in a folder that all executors share, so that a lost executor
    costs a read. Column names must be unique.
    """
    path = f"{checkpoint_dir(df)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``store`` has written, once nothing reads them any more."""
    for table in tables:
        spark = table.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(divisor: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``divisor``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string")) % F.lit(divisor)


def bits_for(df: DataFrame) -> int:
    """Bits of a bitmap with 16 places for each row of a narrow table, within the bound."""
    return min(MAX_BITMAP_BITS, max(16, (16 * df.count()).bit_length()))


def bitmap(df: DataFrame, column: str, bits: int) -> np.ndarray:
    """Bit ``value mod 2**bits`` is set for every value of a long column.

    The words are or-ed on the executors; at most ``2**(bits - 6)`` of them reach the
    driver, whatever the number of rows. A set bit may stand for other values too,
    so a test only thins out rows before a join that decides.
    """
    slot = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    parts = (
        df.filter(F.col(column).isNotNull())
        .select(
            F.shiftright(slot, 6).alias("word"),
            F.expr("1L").alias("one"),
            slot.bitwiseAND(F.lit(63)).cast("int").alias("bit"),
        )
        .select("word", F.expr("shiftleft(one, bit)").alias("set"))
        .groupBy("word")
        .agg(F.bit_or("set").alias("set"))
        .toArrow()
    )
    out = np.zeros(1 << (bits - 6), np.int64)
    out[parts["word"].to_numpy()] = parts["set"].to_numpy()
    return out.view(np.uint64)


def in_bitmap(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of the values have their bit set."""
    x = values.view(np.uint64) & np.uint64(len(bits) * 64 - 1)
    return (bits[(x >> np.uint64(6)).astype(np.int64)] >> (x & np.uint64(63))) & np.uint64(1) == 1
