"""Seed lists and input context rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.functions import text, urls
from sitelens.sources.files import in_file_order, in_path_order
from sitelens.sources.replace import standing


def read_text_seeds(spark: SparkSession, path: str) -> DataFrame:
    """(pos, url) of a text list, in the order of files and lines; blank lines and #
    comments are skipped."""
    lines = in_file_order(spark.read.text(path), "pos").select("pos", text.strip(F.col("value")).alias("line"))
    kept = lines.filter((F.col("line") != "") & ~F.col("line").startswith("#"))
    return kept.select("pos", urls.normalize_url("line").alias("url"))


def read_csv(
    spark: SparkSession, path: str, multiline: bool = True, position: str | None = None
) -> DataFrame:
    """A header CSV as strings; a byte order mark is not part of the first name.

    Line breaks inside quotes belong to their cell; such a file is read by one task.
    ``multiline=False`` lets Spark split files in which no cell has a line break.
    ``position`` names a column that numbers the rows by file and line.
    """
    df = (
        spark.read.option("header", True)
        .option("multiLine", multiline)
        .option("escape", '"')
        .option("nullValue", "\x00")
        .option("emptyValue", "")
        .csv(standing(spark, path))
    )
    if not df.columns:
        raise ValueError(f"CSV input {path} has no header row")
    if position:
        df = in_file_order(df, position)
    return df.withColumnsRenamed({c: c.lstrip("\ufeff") for c in df.columns if c.startswith("\ufeff")})


def resolve_url_column(columns: Sequence[str], requested: str | None = None) -> str:
    """The configured URL column, else ``url``, else ``website``."""
    requested = (requested or "").strip()
    if requested:
        if requested not in columns:
            raise ValueError(f"Configured CSV URL column {requested!r} is not in the input")
        return requested
    for name in ("url", "website"):
        if name in columns:
            return name
    raise ValueError("CSV input needs a url or website column, or a configured url_column")


def csv_seeds(rows: DataFrame, url_column: str | None = None, position: str | None = None) -> DataFrame:
    """(pos, url) of a seed table; blank URL cells are skipped.

    ``position`` is the column that orders the rows. Without it their order is that of
    Spark's partitions, which for several files need not be the files' own.
    """
    name = resolve_url_column([c for c in rows.columns if c != position], url_column)
    pos = F.col(position) if position else F.monotonically_increasing_id()
    numbered = rows.select(pos.alias("pos"), text.strip(F.col(name)).alias("raw"))
    return numbered.filter(F.col("raw") != "").select("pos", urls.normalize_url("raw").alias("url"))


def read_csv_seeds(
    spark: SparkSession, path: str, url_column: str | None = None, multiline: bool = True
) -> DataFrame:
    """(pos, url) of CSV files, in the order of files and lines."""
    return csv_seeds(read_csv(spark, path, multiline, "__pos"), url_column, "__pos")


def read_json_seeds(spark: SparkSession, path: str) -> DataFrame:
    """(pos, url) of JSON files that hold an array, or an object with a ``urls`` array.

    Items become text as JSON prints them; an item that gives no URL has a null url and the
    others stay. A file of another shape ends the read.
    """
    wrong = F.raise_error(F.lit("JSON seeds need a list or a urls field"))
    whole = in_path_order(spark.read.text(path, wholetext=True), "__file")
    parsed = whole.select("__file", F.try_parse_json("value").alias("v"))
    kind = F.schema_of_variant("v")
    inner = F.try_variant_get("v", "$.urls", "variant")
    listed = F.when(kind.startswith("ARRAY"), F.col("v")).when(
        F.schema_of_variant(inner).startswith("ARRAY"), inner
    )
    checked = parsed.select("__file", F.when(listed.isNull(), wrong.cast("variant")).otherwise(listed).alias("v"))
    # One row per item, without making an array of all of them first.
    each = checked.lateralJoin(checked.sparkSession.tvf.variant_explode(F.col("v").outer()))
    item = F.coalesce(F.try_variant_get("value", "$", "string"), F.to_json("value"))
    # Files are numbered in steps of FILE_ROWS: room for the places inside.
    return each.select(
        (F.col("__file") + F.col("pos")).cast("bigint").alias("pos"),
        urls.normalize_url(text.strip(item)).alias("url"),
    )


def assemble_targets(*lists: DataFrame, static: DataFrame | None = None) -> DataFrame:
    """(target_idx, url): distinct URLs, in list order, then position.

    ``static`` targets count only when every other list is empty. ``target_idx``
    keeps the order without numbering all rows in one place, so it has gaps.
    """
    used = [s for s in lists if s is not None]
    if static is not None and all(s.isEmpty() for s in used):
        used = [static]
    union = None
    for ordinal, seeds in enumerate(used):
        part = seeds.select(
            (F.lit(ordinal).cast("bigint") * F.lit(1 << 54) + F.col("pos")).alias("target_idx"), "url"
        )
        union = part if union is None else union.unionByName(part)
    return (
        union.filter(F.col("url").isNotNull())
        .groupBy("url")
        .agg(F.min("target_idx").alias("target_idx"))
        .select("target_idx", "url")
    )


def input_contexts(
    rows: DataFrame, url_column: str | None = None, preserve: Sequence[str] | None = None
) -> DataFrame:
    """(input_url, context columns) per input row; several rows may share a URL."""
    name = resolve_url_column(rows.columns, url_column)
    if preserve:
        kept = [c for c in preserve if c in rows.columns]
    else:
        kept = [c for c in rows.columns if c != name]
    keyed = rows.select(urls.normalize_url(name).alias("input_url"), *kept)
    return keyed.filter(F.col("input_url").isNotNull())
