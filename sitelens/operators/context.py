"""Joining results back to the input rows they came from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.operators.skew import cut_lineage, salted_join


def join_context(
    rows: DataFrame, contexts: DataFrame, key: str = "input_url"
) -> DataFrame:
    """Every result row with every context of its URL; unmatched rows stay.

    On a name clash the result column wins wherever the result has that column.
    A URL that many input rows share is a hot key on the context side, so that
    side is the salted one; unmatched rows come from an anti join on its keys.
    """
    added = [c for c in contexts.columns if c != key and c not in rows.columns]
    # Read more than once below, and its key is costly to normalize.
    narrow = cut_lineage(contexts.select(key, *added))
    matched = salted_join(narrow, rows, [key], known_rows=narrow.count())
    alone = rows.join(narrow.select(key).distinct(), key, "left_anti")
    ordered = [key, *added, *[c for c in rows.columns if c != key]]
    return matched.select(*ordered).unionByName(
        alone.select("*", *[F.lit(None).cast(narrow.schema[c].dataType).alias(c) for c in added])
        .select(*ordered)
    )
