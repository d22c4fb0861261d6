"""Registration of queries with the SQL they are checked against."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.functions.cells import csv_cell
from sitelens.operators.skew import checkpoint_dir


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.oracle: dict[str, str] = {}

    def __call__(self, name: str, oracle: str | None = None) -> Callable:
        def register(run: Callable) -> Callable:
            self.queries[name] = run
            if oracle is not None:
                self.oracle[name] = oracle
            return run

        return register


def scratch(df: DataFrame, name: str) -> str:
    """A new folder next to the checkpoints, which all executors can reach."""
    return f"{checkpoint_dir(df)}/{name}-{uuid.uuid4().hex}"


def flatten_lists(df: DataFrame) -> DataFrame:
    """Arrays joined by "; "; other columns unchanged."""
    return df.select(
        *[
            csv_cell(F.col(f.name), f.dataType).alias(f.name)
            if f.dataType.typeName() == "array"
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )
