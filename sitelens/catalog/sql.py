"""Pieces of check SQL that several queries share (DuckDB dialect)."""

from __future__ import annotations

# Page URLs are lower-case and carry at most a query, a fragment or a final slash.
NORM = "regexp_replace(regexp_replace({u}, '#.*$', ''), '/+$', '')"
HOST = "regexp_extract({u}, '^https?://([^/?#]+)', 1)"
UNESCAPED = (
    "replace(replace(regexp_replace(regexp_replace({c}, '&amp;?', '&', 'g'), '&quot;?', '\"', 'g'),"
    " '&lt;', '<'), '&gt;', '>')"
)
CLEAN = "trim(regexp_replace({c}, '\\s+', ' ', 'g'))"
EMAILS = "regexp_extract_all({c}, '(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+[.][A-Z]{{2,}}')"
PHONES = (
    "list_transform(regexp_extract_all({c}, '(?:[+]?1[\\s\\-.]?)?(?:[(]?\\d{{3}}[)]?[\\s\\-.]?)"
    "\\d{{3}}[\\s\\-.]?\\d{{4}}'), lambda x: trim(x))"
)


def norm(u: str) -> str:
    return NORM.format(u=u)


def distinct_list(expression: str) -> str:
    """Ordered distinct of a list expression that is a plain column name."""
    return f"list_filter({expression}, lambda x, i: list_position({expression}, x) = i)"


def tidy(expression: str) -> str:
    return CLEAN.format(c=UNESCAPED.format(c=expression))
