"""Cleaner modules: named DataFrame steps run in order with row counts."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

Module = Callable[[DataFrame, Mapping], DataFrame]


def rename_columns(df: DataFrame, options: Mapping) -> DataFrame:
    return df.withColumnsRenamed(dict(options.get("mapping", {})))


def normalize_case(df: DataFrame, options: Mapping) -> DataFrame:
    change = {"lower": F.lower, "upper": F.upper, "title": F.initcap}[options.get("case", "lower")]
    names = [c for c in options.get("columns", []) if c in df.columns]
    return df.withColumns({c: change(F.col(c)) for c in names})


MODULES: dict[str, Module] = {
    "core.rename_columns": rename_columns,
    "text.normalize_case": normalize_case,
}


def register_module(name: str, module: Module) -> None:
    """Add or replace a named module."""
    MODULES[name] = module


def run_modules(
    df: DataFrame, steps: Sequence[Mapping]
) -> tuple[DataFrame, list[tuple[str, Observation]]]:
    """Apply the steps in order; row counts are observed while the result runs."""
    observed = []
    loaded = Observation()
    df = df.observe(loaded, F.count(F.lit(1)).alias("rows"))
    observed.append(("rows_loaded", loaded))
    for step in steps:
        name = step.get("module", step.get("id"))
        if name not in MODULES:
            raise ValueError(f"Unknown cleaner module: {name}")
        df = MODULES[name](df, step.get("options", step))
        seen = Observation()
        df = df.observe(seen, F.count(F.lit(1)).alias("rows"))
        observed.append((name, seen))
    return df, observed
