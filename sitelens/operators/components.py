"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.operators.skew import cut_lineage, salted_join


def _open_nodes(edges: DataFrame) -> tuple[int, int]:
    """Edges, and nodes that still stand between others: below two nodes, or below one
    and above another. Without such nodes every component is a star around its lowest."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("down"))
    )
    per_node = ends.groupBy("node").agg(
        F.sum("down").alias("down"), F.count(F.lit(1)).alias("all")
    )
    between = (F.col("down") > 1) | ((F.col("down") == 1) & (F.col("all") > 1))
    row = per_node.agg(
        F.coalesce(F.sum("down"), F.lit(0)).alias("edges"), F.count_if(between).alias("open")
    ).first()
    return row["edges"], row["open"]


def _large_star(edges: DataFrame, known: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (
        salted_join(both, lowest, ["u"], known_rows=2 * known)
        .filter(F.col("v") > F.col("u"))
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .filter(F.col("u") != F.col("v"))
        .distinct()
    )


def _small_star(edges: DataFrame, known: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    lowest = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = salted_join(down, lowest, ["u"], known_rows=known)
    return (
        linked.select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionByName(lowest.select("u", F.col("m").alias("v")))
        .filter(F.col("u") != F.col("v"))
        .distinct()
    )


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of an edge table ``u, v``.

    The component is its smallest node. Stars of a hub are never gathered: every
    round is a min per node, which shrinks before the shuffle, and a join whose
    hot nodes are salted. The number of rounds grows with the logarithm of the
    number of nodes, not with the length of chains.
    """
    edges = cut_lineage(
        edges.filter(F.col("u") != F.col("v"))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    known, between = _open_nodes(edges)
    while between:
        edges = cut_lineage(_small_star(_large_star(edges, known), known))
        known, between = _open_nodes(edges)
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
