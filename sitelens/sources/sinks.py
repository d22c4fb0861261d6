"""Writers. Each replaces its output whole or leaves it as it was (see ``replace``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelens.operators.records import flatten_for_csv, flattened
from sitelens.plans.report import run_report
from sitelens.plans.result import Result
from sitelens.plans.spec import ShapingSpec, read_shaping
from sitelens.sources.replace import replacing


def write_csv(df: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    """CSV with a header; preferred columns first, any others after them.

    Preferred columns that no row has are written empty.
    """
    preferred = list(columns or [])
    ordered = [F.col(c) if c in df.columns else F.lit("").alias(c) for c in preferred]
    ordered += [F.col(c) for c in df.columns if c not in preferred]
    flat = flatten_for_csv(df.select(*ordered))
    with replacing(df.sparkSession, path) as target:
        flat.write.options(
            header=True, escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
        ).csv(target)


def json_value(name: str, c: Column, kind: T.DataType, shaping: ShapingSpec) -> Column:
    """A column as it goes to JSON: one-item lists become the bare item if asked."""
    if isinstance(kind, T.ArrayType) and flattened(name, True, shaping):
        single = F.to_json(F.struct(F.element_at(c, 1).alias("v")))
        item = F.regexp_extract(single, r'(?s)^\{"v":(.*)\}$', 1)
        return F.parse_json(F.when(F.size(c) == 1, item).otherwise(F.to_json(c)))
    return c


def write_json(df: DataFrame, path: str, shaping=None) -> None:
    """JSON Lines. Nulls are left out of a row when empty fields are dropped."""
    shaping = read_shaping(shaping)
    columns = [json_value(f.name, F.col(f.name), f.dataType, shaping).alias(f.name) for f in df.schema.fields]
    with replacing(df.sparkSession, path) as target:
        df.select(*columns).write.option("ignoreNullFields", shaping.drop_empty_fields).json(target)


# Tables of a result that are written beside its report.
REPORT_TABLES = ["targets", "issues", "warnings", "cleanup", "coverage", "summary", "limits", "stats"]


def write_report(result: Result, path: str, **about) -> None:
    """Replace ``path`` by the report of a run: one nested record under run_report.json,
    and the tables of the result, a JSON folder each. ``about`` is what ``run_report`` takes."""
    with replacing(result.rows.sparkSession, path) as target:
        run_report(result, **about).coalesce(1).write.json(f"{target}/run_report.json")
        for name in REPORT_TABLES:
            table = getattr(result, name)
            if table is not None:
                table.write.json(f"{target}/{name}")


def write_results(result: Result, path: str, shaping=None, **about) -> None:
    """The rows of a job as CSV and JSON in its output columns, and its report."""
    write_csv(result.rows, f"{path}/results.csv", result.columns)
    write_json(result.rows, f"{path}/results.json", shaping)
    write_report(result, f"{path}/report", **about)


def write_with_cleaned(
    rows: DataFrame, path: str, settings: dict, columns: Sequence[str] | None = None
) -> dict:
    """Write the standard CSV and, beside it, the cleaned leads.

    A failure of the cleaned output is reported and does not stop the run.
    """
    from sitelens.operators.leads import clean_leads

    write_csv(rows, f"{path}/results.csv", columns)
    if not settings.get("enabled"):
        return {"enabled": False}
    name = str(settings.get("file_name") or "").strip() or "cleaned_results.csv"
    target = f"{path}/{name}"
    try:
        cleaned = clean_leads(rows, settings)
        write_csv(cleaned.rows, target, settings.get("include_fields"))
        stats = cleaned.stats.first().asDict()
    except Exception as error:
        return {"enabled": True, "path": target, "success": False, "error": str(error)}
    return {"enabled": True, "path": target, "success": True, **stats}


def union_rows(*parts: DataFrame) -> DataFrame:
    """Row sets with differing columns as one, missing values null."""
    total = parts[0]
    for part in parts[1:]:
        total = total.unionByName(part, allowMissingColumns=True)
    return total
