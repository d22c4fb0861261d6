"""Text helpers as Column expressions. Whitespace follows Python's ``str`` rules."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.isspace() accepts.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WHITESPACE_CLASS = (
    r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
)

# What counts as an e-mail address and as a US phone number.
# \G or a non-address character must precede the local part, and the local part
# is possessive, so a long run without "@" is scanned once instead of n times.
EMAIL_PATTERN = (
    r"(?iu)(?:\G|(?<![A-Z0-9._%+-]))[A-Z0-9._%+-]++@[A-Z0-9.-]+\.[A-Z]{2,}"
)
PHONE_PATTERN = (
    r"(?U)(?:\+?1[\s\x1c-\x1f\-.]?)?(?:\(?\d{3}\)?[\s\x1c-\x1f\-.]?)"
    r"\d{3}[\s\x1c-\x1f\-.]?\d{4}"
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once so ``body`` can mention it many times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def cached_by_name(build: Callable[..., Column]) -> Callable[..., Column]:
    """Let ``build`` take column names too, and keep what it built for them.

    Long expressions cost a second of driver time to put together; the same
    expression over the same columns can be used in many plans.
    """
    kept = functools.lru_cache(maxsize=256)(
        lambda *names: build(*[F.col(n) if isinstance(n, str) else n for n in names])
    )

    @functools.wraps(build)
    def call(*args):
        plain = all(a is None or isinstance(a, str) for a in args)
        if plain:
            return kept(*args)
        return build(*[F.col(a) if isinstance(a, str) else a for a in args])

    return call


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def clean_whitespace(c: Column) -> Column:
    """Runs of whitespace as one space, none at the ends.

    Single spaces are left alone, so ordinary text is only scanned.
    """
    untidy = f"(?: {WHITESPACE_CLASS}|(?! ){WHITESPACE_CLASS}){WHITESPACE_CLASS}*+"
    return F.trim(F.regexp_replace(c, untidy, " "))


def ordered_distinct(items: Column) -> Column:
    """Strip items, drop blanks and nulls, keep the first of each value."""
    stripped = F.transform(items, strip)
    return F.array_distinct(F.filter(stripped, lambda x: x != ""))


def _no_strings() -> Column:
    return F.array().cast("array<string>")


def extract_emails(c: Column) -> Column:
    """Distinct addresses in order; text without "@" is not scanned."""
    found = F.regexp_extract_all(c, F.lit(EMAIL_PATTERN), F.lit(0))
    return F.when(c.contains("@"), ordered_distinct(found)).otherwise(_no_strings())


def extract_phones(c: Column) -> Column:
    """Distinct US phone numbers in order; text without four digits is not scanned."""
    found = F.regexp_extract_all(c, F.lit(PHONE_PATTERN), F.lit(0))
    return F.when(c.rlike(r"(?U)\d{4}"), ordered_distinct(found)).otherwise(_no_strings())


def blank(c: Column) -> Column:
    """Emptiness of a string column; never null."""
    return c.isNull() | (c == "")


def blank_list(c: Column) -> Column:
    """Emptiness of an array column; never null."""
    return c.isNull() | (F.size(c) == 0)


def is_empty(c: Column, is_list: bool) -> Column:
    return blank_list(c) if is_list else blank(c)


def null_if_empty(c: Column, is_list: bool) -> Column:
    return F.when(~is_empty(c, is_list), c)


def first_item(items: Column) -> Column:
    return F.try_element_at(items, F.lit(1))


def slugify(c: Column) -> Column:
    slug = F.btrim(F.regexp_replace(F.lower(strip(c)), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.when(slug == "", F.lit("run")).otherwise(slug)


def strip_trailing_timestamp(c: Column) -> Column:
    base = strip(c)
    cut = F.regexp_replace(base, r"(?:_\d{8}_\d{6})+$", "")
    return F.when(cut == "", base).otherwise(cut)


def list_literal(items: Column) -> Column:
    """The text Python prints for a list of strings, used for length scoring."""
    quoted = F.transform(
        items,
        lambda x: F.when(
            x.contains("'") & ~x.contains('"'), F.concat(F.lit('"'), x, F.lit('"'))
        ).otherwise(
            F.concat(
                F.lit("'"),
                F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")),
                F.lit("'"),
            )
        ),
    )
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))
