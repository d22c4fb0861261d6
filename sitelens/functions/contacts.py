"""Heuristics on titles, addresses, phones and company names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitelens.functions.text import (
    blank,
    clean_whitespace,
    first_item,
    let,
    ordered_distinct,
    strip,
)

# A street address in running text, and the separators between a
# business name and the rest of a title, most trusted first.
ADDRESS_PATTERN = (
    r"(?iuU)\b\d{1,6}\s+[A-Z0-9][A-Z0-9\s.,#-]{6,120}\b"
    r"(?:,\s*[A-Z .'-]+,\s*[A-Z]{2}\s+\d{5}(?:-\d{4})?)?"
)
TITLE_SEPARATORS = [" | ", " - ", " :: ", " / "]


def derive_business_name(title: Column, headings: Column) -> Column:
    """The first heading if it reads like a name, else the front of the title."""
    heading = first_item(F.filter(headings, lambda x: x != ""))
    words = F.size(F.split(clean_whitespace(heading), " "))

    def front(t: Column) -> Column:
        cut = None
        for separator in TITLE_SEPARATORS:
            part = F.substring_index(t, separator, 1)
            present = t.contains(separator)
            cut = F.when(present, part) if cut is None else cut.when(present, part)
        return clean_whitespace(cut.otherwise(t))

    name = let(title, front)
    return F.when(heading.isNotNull() & words.between(2, 8), heading).otherwise(
        F.when(~blank(name), name)
    )


def extract_address(html: Column, candidates: Column) -> Column:
    """First plausible candidate, else the first address in the raw text."""
    plausible = first_item(
        F.filter(
            F.transform(ordered_distinct(candidates), clean_whitespace),
            lambda x: F.length(x).between(10, 180) & x.rlike(r"(?U)\d"),
        )
    )
    return F.coalesce(plausible, address_in_text(html))


def address_in_text(html: Column) -> Column:
    found = F.regexp_extract(F.coalesce(html, F.lit("")), ADDRESS_PATTERN, 0)
    return F.when(found != "", clean_whitespace(found))


def normalize_email(c: Column) -> Column:
    return F.coalesce(F.lower(strip(c)), F.lit(""))


def normalize_phones(values: Column) -> Column:
    """Digits of every phone in an array of free-text values, in order."""
    pieces = F.flatten(
        F.transform(
            F.filter(values, lambda x: x.isNotNull()),
            lambda v: F.split(v, r"[;,\n/|]+"),
        )
    )
    digits = F.transform(pieces, lambda p: F.regexp_replace(p, r"(?U)\D+", ""))
    national = F.transform(
        digits,
        lambda d: F.when((F.length(d) == 11) & d.startswith("1"), F.substr(d, F.lit(2))).otherwise(d),
    )
    return F.array_distinct(F.filter(national, lambda d: F.length(d).between(7, 15)))


def normalize_company(c: Column) -> Column:
    lowered = F.lower(F.coalesce(c, F.lit("")))
    return F.trim(F.regexp_replace(lowered, "[^a-z0-9]+", " "))
