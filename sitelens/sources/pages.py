"""Page archives: captured pages with their gates, and the raw page store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitelens.functions import urls
from sitelens.sources.replace import replacing


def spread(df: DataFrame) -> DataFrame:
    """Give a scan of long texts at least one task per core.

    Parsing costs far more than reading, so an input with fewer splits than the
    cluster has cores is spread out first. Larger inputs stay as they are. Meant
    for plain scans: other plans would be run to count their partitions.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def gate_pages(pages: DataFrame) -> DataFrame:
    """Turn captures that are not markup into error pages and flag redirects.

    Needs requested_url, url and html; content_type, status_code and error are
    used where present.
    """
    have = pages.columns
    kind = F.lower(F.coalesce("content_type", F.lit(""))) if "content_type" in have else F.lit("html")
    fetched = F.col("error") if "error" in have else F.lit(None).cast("string")
    wrong = ~(kind.contains("html") | kind.contains("xml"))
    error = F.coalesce(
        fetched,
        F.when(
            wrong,
            F.concat(F.lit("Unsupported content type: "), F.when(kind == "", "unknown").otherwise(kind)),
        ),
    )
    status = F.col("status_code").cast("int") if "status_code" in have else F.lit(None).cast("int")
    requested = urls.normalize_url("requested_url")
    final = F.when(fetched.isNull(), urls.normalize_url("url")).otherwise(F.col("url"))
    extra = [c for c in have if c not in ("requested_url", "url", "content_type", "status_code", "error", "html")]
    return pages.select(
        *extra,
        F.coalesce(requested, F.col("requested_url")).alias("requested_url"),
        final.alias("url"),
        status.alias("status_code"),
        error.alias("error"),
        (F.coalesce(requested != final, F.lit(False)) & error.isNull()).alias("redirected"),
        F.when(error.isNull(), F.col("html")).alias("html"),
    )


def page_archive(pages: DataFrame, order: str) -> DataFrame:
    """One capture per requested URL: the first by ``order``, which no URL has twice.

    The first is found on two narrow columns, and what loses is taken away. Repeated
    captures are few, so Spark can send their keys to the pages (it does where they
    are small) instead of moving or sorting HTML.
    """
    narrow = pages.select("requested_url", F.col(order).alias("__order"))
    first = narrow.groupBy("requested_url").agg(F.min("__order").alias("__first"))
    later = (
        narrow.join(first, "requested_url")
        .filter(F.col("__order") > F.col("__first"))
        .select(F.col("requested_url").alias("__url"), "__order")
    )
    lost = (F.col("requested_url") == F.col("__url")) & (F.col(order) == F.col("__order"))
    return pages.join(later, lost, "left_anti")


def label_pages(visits: DataFrame, url: str = "url", number: str = "page_number") -> DataFrame:
    """Add the label under which a raw page is stored."""
    return visits.withColumn("label", urls.page_label(url, number))


def number_pages(visits: DataFrame, seed: str = "seed", rank: str = "visit_rank") -> DataFrame:
    """Page numbers per seed; a seed has at most ``max_pages`` visits."""
    return visits.withColumn(
        "page_number", F.row_number().over(W.partitionBy(seed).orderBy(rank))
    )


def store_raw_pages(visits: DataFrame, path: str) -> None:
    """Write labelled raw pages (seed, label, url, html); pages without HTML are skipped."""
    kept = visits.filter(F.col("html").isNotNull() & (F.col("html") != ""))
    with replacing(visits.sparkSession, path) as target:
        label_pages(kept).select("seed", "label", "url", "html").write.parquet(target)
