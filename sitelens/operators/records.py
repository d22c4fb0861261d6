"""Record processing and output shaping, one ``select`` each, with their counters."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelens.functions import text
from sitelens.functions.cells import csv_cell
from sitelens.functions.transforms import apply_chain
from sitelens.operators.extract import default_value
from sitelens.plans.spec import FieldSpec, ShapingSpec

# The names of the cleanup counters.
CLEANUP_ACTIONS = [
    "duplicate_list_items_removed", "fields_flattened", "fields_joined",
    "list_items_dropped", "mailto_prefix_removed", "tel_prefix_removed",
]


def is_list(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.ArrayType)


def text_present(c: Column) -> Column:
    return ~text.blank(c)


def processed_value(c: Column, field: FieldSpec, listed: bool, empty_like: Sequence[str]) -> Column:
    """A field value after its transforms, falling back to the default."""
    fallback = default_value(field, listed)
    if listed:
        items = F.transform(c, lambda x: apply_chain(x, field.transforms, empty_like)[0])
        value = text.ordered_distinct(F.filter(items, lambda x: x.isNotNull() & (x != "")))
        if any(t.get("name") == "default_if_empty" for t in field.transforms):
            # A missing list runs through the chain as one missing value.
            alone = apply_chain(F.lit(None).cast("string"), field.transforms, empty_like)[0]
            value = F.when(c.isNotNull(), value).otherwise(F.filter(F.array(alone), text_present))
    else:
        value = apply_chain(c, field.transforms, empty_like)[0]
    return text.let(
        value,
        lambda v: F.when(~text.is_empty(v, listed), v).otherwise(
            F.lit(None) if fallback is None else fallback
        ),
    )


def transform_issues(
    c: Column, field: FieldSpec, listed: bool, empty_like: Sequence[str]
) -> list[tuple[str, Column]]:
    """(message, number of values it concerns) for unusable transforms of a field."""
    messages = [m for m, _ in apply_chain(c, field.transforms, empty_like)[1]]
    if not listed:
        return apply_chain(c, field.transforms, empty_like)[1]

    def total(index: int) -> Column:
        flags = F.transform(c, lambda x: apply_chain(x, field.transforms, empty_like)[1][index][1])
        return F.coalesce(F.aggregate(flags, F.lit(0), lambda acc, x: acc + x), F.lit(0))

    return [(message, total(i)) for i, message in enumerate(messages)]


ISSUES = "array<struct<field:string,message:string,n:int>>"


def process_records(
    df: DataFrame,
    fields: Sequence[FieldSpec],
    empty_like: Sequence[str] = (),
    prefix: str = "",
    issues: str | None = None,
) -> DataFrame:
    """Apply the transforms of every configured field; other columns pass through.

    The column of a field is its name behind ``prefix``. With ``issues`` a column
    of that name lists the transforms that could not be applied to the record.
    """
    by_name = {prefix + f.name: f for f in fields}
    columns, found = [], []
    for name in df.columns:
        field = by_name.pop(name, None)
        if field is None:
            columns.append(F.col(name))
            continue
        listed = is_list(df, name)
        columns.append(processed_value(F.col(name), field, listed, empty_like).alias(name))
        for message, count in transform_issues(F.col(name), field, listed, empty_like):
            found.append(
                F.struct(
                    F.lit(field.name).alias("field"),
                    F.lit(f"{field.name}: {message}").alias("message"),
                    count.cast("int").alias("n"),
                )
            )
    for name, field in by_name.items():
        missing = F.lit(None).cast("array<string>" if field.many else "string")
        columns.append(processed_value(missing, field, field.many, empty_like).alias(name))
    if issues:
        listed_issues = F.filter(F.array(*found), lambda i: i.n > 0) if found else F.array()
        columns.append(listed_issues.cast(ISSUES).alias(issues))
    return df.select(*columns)


def count_warnings(records: DataFrame, *issues: str) -> DataFrame:
    """Warnings by category, field and message from the issue columns of records."""
    entries = F.flatten(
        F.array(*[F.coalesce(F.col(c), F.array().cast(ISSUES)) for c in issues])
    )
    return (
        records.select(F.inline(entries))
        .groupBy(F.lit("field_transform").alias("category"), "field", "message")
        .agg(F.sum("n").alias("count"))
    )


def transform_warnings(
    df: DataFrame, fields: Sequence[FieldSpec], empty_like: Sequence[str] = ()
) -> DataFrame:
    """Warnings of unprocessed records."""
    return count_warnings(process_records(df, fields, empty_like, issues="__issues"), "__issues")


# -- shaping ------------------------------------------------------------------


def _prefix_rules(name: str) -> list[tuple[str, str]]:
    """(prefix, counter) pairs removed from values of a field with this name."""
    lowered = name.lower()
    rules = []
    if "email" in lowered:
        rules.append(("mailto:", "mailto_prefix_removed"))
    if "phone" in lowered or "tel" in lowered:
        rules.append(("tel:", "tel_prefix_removed"))
    return rules


def clean_scalar(name: str, c: Column, shaping: ShapingSpec) -> Column:
    value = text.strip(c)
    if shaping.cleanup_common_fields:
        for prefix, _ in _prefix_rules(name):
            value = F.regexp_replace(value, f"(?i)^{prefix}", "")
    return value


def _clean_items(name: str, c: Column, shaping: ShapingSpec) -> Column:
    return F.filter(
        F.transform(c, lambda x: clean_scalar(name, x, shaping)), lambda x: x != ""
    )


def shaped_value(name: str, c: Column, listed: bool, shaping: ShapingSpec) -> Column:
    """Cleaned output value. Lists stay lists unless they are joined."""
    if not listed:
        value = clean_scalar(name, c, shaping)
        return F.when(value != "", value) if shaping.drop_empty_fields else value
    value = text.ordered_distinct(_clean_items(name, c, shaping))
    if name in shaping.join_fields:
        joined = F.array_join(value, shaping.join_fields[name])
        return F.when(joined != "", joined) if shaping.drop_empty_fields else joined
    if shaping.drop_empty_fields:
        return text.let(value, lambda v: F.when(F.size(v) > 0, v))
    return value


def flattened(name: str, listed: bool, shaping: ShapingSpec) -> bool:
    """Whether one-item lists of this field are written as the bare item."""
    return (
        listed
        and name not in shaping.join_fields
        and (shaping.flatten_single_item_lists or name in shaping.flatten_fields)
    )


def shaped_columns(columns: Sequence[str], shaping: ShapingSpec) -> list[str]:
    """Included, not excluded, ordered."""
    kept = [
        c
        for c in columns
        if (not shaping.include_fields or c in shaping.include_fields)
        and c not in shaping.exclude_fields
    ]
    first = [c for c in dict.fromkeys(shaping.field_order) if c in kept]
    return first + [c for c in kept if c not in first]


def shape_records(df: DataFrame, shaping: ShapingSpec) -> DataFrame:
    """Clean, filter and order the output columns in one projection.

    Values that ``drop_empty_fields`` would remove from a row become null; the
    JSON writer leaves nulls out.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    columns = []
    for name in shaped_columns(df.columns, shaping):
        kind = types[name]
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
            columns.append(shaped_value(name, F.col(name), True, shaping).alias(name))
        elif isinstance(kind, T.StringType):
            columns.append(shaped_value(name, F.col(name), False, shaping).alias(name))
        else:
            columns.append(F.col(name))
    return df.select(*columns)


def cleanup_flags(name: str, c: Column, listed: bool, shaping: ShapingSpec) -> dict[str, Column]:
    """How often each cleanup action applies to one value."""
    flags: dict[str, Column] = {}

    def count(items: Column) -> Column:
        return F.coalesce(F.size(items), F.lit(0))

    rules = _prefix_rules(name) if shaping.cleanup_common_fields else []
    for prefix, counter in rules:
        pattern = f"(?i)^{prefix}"
        if listed:
            hits = F.filter(c, lambda x: text.strip(x).rlike(pattern))
            flags[counter] = F.when(c.isNotNull(), F.size(hits)).otherwise(0)
        else:
            flags[counter] = F.coalesce(text.strip(c).rlike(pattern), F.lit(False)).cast("int")
    if not listed:
        return flags
    kept = _clean_items(name, c, shaping)
    distinct = text.ordered_distinct(kept)
    present = c.isNotNull()
    flags["list_items_dropped"] = F.when(present, F.size(c) - F.size(kept)).otherwise(0)
    flags["duplicate_list_items_removed"] = F.when(
        present, F.size(kept) - F.size(distinct)
    ).otherwise(0)
    if name in shaping.join_fields:
        flags["fields_joined"] = F.when(present & (F.size(distinct) > 0), 1).otherwise(0)
    elif flattened(name, True, shaping):
        flags["fields_flattened"] = F.when(present & (F.size(distinct) == 1), 1).otherwise(0)
    return flags


def cleanup_counters(df: DataFrame, shaping: ShapingSpec) -> DataFrame:
    """One row per cleanup action with its total over all records and fields."""
    per_action: dict[str, list[Column]] = {a: [] for a in CLEANUP_ACTIONS}
    for f in df.schema.fields:
        listed = isinstance(f.dataType, T.ArrayType)
        if listed or isinstance(f.dataType, T.StringType):
            for action, flag in cleanup_flags(f.name, F.col(f.name), listed, shaping).items():
                per_action[action].append(flag)
    totals = df.agg(
        *[
            F.coalesce(
                F.sum(reduce(lambda a, b: a + b, flags, F.lit(0)).cast("bigint")), F.lit(0)
            ).alias(action)
            for action, flags in per_action.items()
        ]
    )
    return totals.unpivot([], CLEANUP_ACTIONS, "action", "count")


def flatten_for_csv(df: DataFrame) -> DataFrame:
    """Every column as CSV text: lists joined by "; ", maps as JSON, nulls empty."""
    return df.select(*[csv_cell(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def output_columns(
    row_columns: Sequence[str],
    fields: Sequence[FieldSpec],
    detail_fields: Sequence[FieldSpec] = (),
    shaping: ShapingSpec | None = None,
    schema_columns: Sequence[str] = (),
) -> list[str]:
    """Preferred columns first, then whatever else the rows carry."""
    shaping = shaping or ShapingSpec()
    preferred = list(schema_columns) or [
        "input_url", "source_url", "page_url", "status_code",
        *[f.name for f in fields], *[f.name for f in detail_fields], "source_urls",
    ]
    return shaped_columns(list(dict.fromkeys([*preferred, *row_columns])), shaping)


def in_output_order(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns of ``rows`` as ``output_columns`` orders them; others after them."""
    first = [c for c in columns if c in rows.columns]
    return rows.select(*first, *[c for c in rows.columns if c not in first])
