"""What files tell about the rows read from them: their path and the order of their lines."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# A file has fewer rows than this; monotonically_increasing_id counts in as many bits.
FILE_ROWS = 1 << 33


@contextmanager
def listed_by_cores(spark: SparkSession) -> Iterator[None]:
    """Readers made here list their folders in a few tasks per core, not one per folder."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    cores = spark.sparkContext.defaultParallelism
    spark.conf.set(key, str(min(int(before), 4 * cores)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def plain_path(c: Column) -> Column:
    """A path without scheme, host and final slash, however a file system writes it."""
    bare = F.regexp_replace(c, r"^[A-Za-z][A-Za-z0-9+.\-]*:(//[^/]*)?(?=/)", "")
    return F.regexp_replace(bare, "(?<=.)/+$", "")


def file_path() -> Column:
    """The plain path of the file that a row was read from."""
    written = F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))
    return plain_path(F.coalesce(F.try_url_decode(written), F.col("_metadata.file_path")))


def in_path_order(rows: DataFrame, position: str) -> DataFrame:
    """Add ``position`` to rows that are whole files: FILE_ROWS times the number of the file,
    in the order of paths, whichever task reads it.

    ``rows`` comes straight from a reader of files. Only the paths are numbered, in one place.
    """
    path = F.col("_metadata.file_path").alias("__path")
    file = F.row_number().over(W.orderBy("__path")).cast("bigint") - 1
    paths = rows.select(path).distinct()
    numbered = paths.select("__path", (file * F.lit(FILE_ROWS)).alias(position))
    joined = rows.select("*", path).join(F.broadcast(numbered), "__path")
    return joined.select(*rows.columns, position)


def in_file_order(rows: DataFrame, position: str) -> DataFrame:
    """Add ``position``: FILE_ROWS times the number of the file, in the order of paths, plus
    the number of the row in its file, however Spark has cut and packed the files into tasks.

    ``rows`` comes straight from a reader of files. Only the splits are numbered, in one
    place; the driver that listed the files has held as many. The files are read twice; where
    Spark cuts or packs them otherwise the second time, the read ends.
    """
    # Both reads of the files are cut alike, so a row has the same number in its task in both.
    lines = F.monotonically_increasing_id().bitwiseAND(F.lit(FILE_ROWS - 1))
    path, start = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    here = rows.select("*", path.alias("__path"), start.alias("__start"), lines.alias("__line"))
    splits = (
        rows.select(path.alias("__path"), start.alias("__start"), lines.alias("__line"))
        .groupBy("__path", "__start")
        .agg(F.min("__line").alias("__first"), F.count(F.lit(1)).alias("__n"))
    )
    along = W.partitionBy("__path").orderBy("__start").rowsBetween(W.unboundedPreceding, -1)
    file = F.dense_rank().over(W.orderBy("__path")).cast("bigint") - 1
    before = F.coalesce(F.sum("__n").over(along), F.lit(0))
    numbered = splits.select(
        "__path", "__start", "__first", "__n", (file * F.lit(FILE_ROWS) + before).alias("__from")
    )
    joined = here.join(F.broadcast(numbered), ["__path", "__start"], "left")
    line = F.col("__line") - F.col("__first")
    unlike = F.raise_error(F.lit("Files were cut or packed otherwise between two reads of their lines"))
    place = F.when(line.between(0, F.col("__n") - 1), F.col("__from") + line).otherwise(unlike.cast("bigint"))
    return joined.select(*rows.columns, place.alias(position))
