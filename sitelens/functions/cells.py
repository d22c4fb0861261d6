"""Values of any type as the text of a CSV cell, by an expression built from the type.

Strings stay as they are, nulls are empty, lists are their non-empty items joined by
"; " (lists inside lists likewise), maps and structs are JSON with sorted keys, all other
values print as Python prints them (of reals beyond 10^15 Java may give a digit more).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelens.functions.text import let

_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_REALS = (T.FloatType, T.DoubleType)
# Python writes reals without an exponent between these powers of ten.
_PLAIN_FROM, _PLAIN_TO = -4, 16


def real_text(c: Column) -> Column:
    """A real number as Python prints it: 1e+16, 1e-05, 10000000.0, nan, inf."""

    def rewritten(s: Column) -> Column:
        sign = F.regexp_extract(s, "^-?", 0)
        whole = F.regexp_extract(s, r"(\d)\.", 1)
        digits = F.regexp_replace(F.regexp_extract(s, r"\.(\d+)E", 1), "0+$", "")
        power = F.regexp_extract(s, r"E(-?\d+)", 1).cast("int")
        tail = F.length(digits)
        shifted = F.concat(whole, F.rpad(digits, F.greatest(power, tail), F.lit("0")))
        large = F.concat(
            F.substring(shifted, F.lit(1), power + 1),
            F.lit("."),
            F.when(tail > power, F.substring(digits, power + 1, tail - power)).otherwise("0"),
        )
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), whole, digits)
        scientific = F.concat(
            whole,
            F.when(digits != "", F.concat(F.lit("."), digits)).otherwise(""),
            F.when(power < 0, "e-").otherwise("e+"),
            F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), F.lit("0")),
        )
        plain = (power >= _PLAIN_FROM) & (power < _PLAIN_TO)
        body = F.when(~plain, scientific).when(power >= 0, large).otherwise(small)
        return F.when(~s.contains("E"), s).otherwise(F.concat(sign, body))

    return (
        F.when(F.isnan(c), "nan")
        .when(c == float("inf"), "inf")
        .when(c == float("-inf"), "-inf")
        .otherwise(let(c.cast("string"), rewritten))
    )


def csv_cell(c: Column, kind: T.DataType) -> Column:
    """The text of a value in a CSV cell; never null."""
    if isinstance(kind, T.StringType):
        text = c
    elif isinstance(kind, T.ArrayType):
        items = F.transform(c, lambda x: csv_cell(x, kind.elementType))
        text = F.array_join(F.filter(items, lambda x: x != ""), "; ")
    elif isinstance(kind, (T.MapType, T.StructType)):
        text = F.when(c.isNotNull(), json_text(c, kind))
    elif isinstance(kind, T.BooleanType):
        text = F.when(c, "True").when(~c, "False")
    elif isinstance(kind, _REALS):
        text = real_text(c)
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit(""))


def list_cell(name: str) -> Column:
    """A column of strings as its CSV cell."""
    return csv_cell(F.col(name), T.ArrayType(T.StringType()))


def _quoted(c: Column) -> Column:
    """A string as a JSON string."""
    return F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)


def json_text(c: Column, kind: T.DataType) -> Column:
    """A value as JSON with sorted keys, ", " and ": " between items; nulls are null."""
    if isinstance(kind, T.ArrayType):
        items = F.transform(c, lambda x: json_text(x, kind.elementType))
        text = F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))
    elif isinstance(kind, T.MapType):
        pairs = F.transform(
            F.array_sort(F.map_keys(c)),
            lambda k: F.concat(
                _quoted(csv_cell(k, kind.keyType)), F.lit(": "), json_text(F.element_at(c, k), kind.valueType)
            ),
        )
        text = F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))
    elif isinstance(kind, T.StructType):
        pairs = [
            F.concat(_quoted(F.lit(f.name)), F.lit(": "), json_text(c[f.name], f.dataType))
            for f in sorted(kind.fields, key=lambda f: f.name)
        ]
        text = F.concat(F.lit("{"), F.concat_ws(", ", *pairs), F.lit("}"))
        text = F.when(c.isNotNull(), text)
    elif isinstance(kind, (T.BooleanType, *_INTEGERS)):
        text = c.cast("string")
    elif isinstance(kind, _REALS):
        names = {"nan": "NaN", "inf": "Infinity", "-inf": "-Infinity"}
        text = let(real_text(c), lambda s: F.coalesce(*[F.when(s == k, v) for k, v in names.items()], s))
    else:
        text = _quoted(c.cast("string"))
    return F.when(c.isNull(), "null").otherwise(text)
