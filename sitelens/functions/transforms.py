"""Field transforms: ordered chains applied to the values of one field.

Every transform maps a string Column to a string Column. After each step blank
and empty-like strings become null, and nulls skip every step but
``default_if_empty``. Unknown or unusable transforms keep the value and report a
message together with the condition under which it applies to a value.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark import SparkContext
from pyspark.errors import PySparkException
from pyspark.sql import Column
from pyspark.sql import functions as F

from sitelens.functions.text import WHITESPACE_CLASS, clean_whitespace, let, strip

Transform = Callable[[Column, Mapping], Column]


class UnusableTransform(Exception):
    """Raised at plan time; ``when`` limits it to values that meet a condition."""

    def __init__(self, message: str, when: Callable[[Column], Column] | None = None) -> None:
        super().__init__(message)
        self.when = when or (lambda c: F.lit(True))


def java_pattern(pattern: str) -> str:
    """A Python pattern for Java's engine: Unicode classes, \\n-only lines, group names
    ``g1, g2, ...`` (Java's have no underscore), and plain ``[`` and ``&&`` in classes."""
    names = re.compile(pattern).groupindex
    out, at = [], 0
    while at < len(pattern):
        rest = pattern[at:]
        if rest[0] == "\\":
            out.append("\\z" if rest[:2] == "\\Z" else rest[:2])
            at += 2
        elif rest[0] == "[":
            inner, at = _java_class(pattern, at)
            out.append(inner)
        elif named := re.match(r"\(\?P<(\w+)>|\(\?P=(\w+)\)", rest):
            opens = named[1] is not None
            number = names[named[1] or named[2]]
            out.append(f"(?<g{number}>" if opens else f"\\{number}(?:)")
            at += named.end()
        elif rest.startswith("{,"):
            out.append("{0,")
            at += 2
        else:
            out.append(rest[0])
            at += 1
    return "(?dU)" + "".join(out)


def _java_class(pattern: str, at: int) -> tuple[str, int]:
    """A character class in Java's terms, and where it ends."""
    end = at + 2 if pattern[at + 1 : at + 2] == "^" else at + 1
    out = [pattern[at:end]]
    first = end
    while end < len(pattern) and (pattern[end] != "]" or end == first):
        char = pattern[end]
        if char == "\\":
            out.append(pattern[end : end + 2])
            end += 1
        else:
            out.append("\\" + char if char in "[]&" else char)
        end += 1
    return "".join(out) + "]", end + 1


def java_replacement(replacement: str, names: Mapping[str, int] | None = None) -> str:
    """``\\1``, ``\\g<1>`` and ``\\g<name>`` as Java group references."""

    def plain(text: str) -> str:
        # A digit after a reference would be read as a part of it.
        if pieces and re.fullmatch(r"\$\d+", pieces[-1]) and text[:1].isdigit():
            text = "\\" + text
        return text.replace("$", r"\$")

    pieces: list[str] = []
    at = 0
    for ref in re.finditer(r"\\g<(\w+)>|\\([1-9]\d?)|\\(.)", replacement, re.S):
        pieces.append(plain(replacement[at : ref.start()]))
        if group := ref[1] or ref[2]:
            pieces.append(f"${int(group) if group.isdigit() else (names or {})[group]}")
        else:
            known = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\\\"}
            pieces.append(known.get(ref[3], "\\\\" + ref[3]))
        at = ref.end()
    pieces.append(plain(replacement[at:]))
    return "".join(pieces)


def _compiled(options: Mapping) -> tuple[re.Pattern, str]:
    """The pattern, and its translation, which Java has accepted."""
    if "pattern" not in options:
        raise UnusableTransform("'pattern'")
    try:
        compiled = re.compile(options["pattern"])
        java = java_pattern(options["pattern"])
    except (re.error, TypeError) as problem:
        raise UnusableTransform(str(problem)) from None
    try:
        SparkContext._active_spark_context._jvm.java.util.regex.Pattern.compile(java)
    except PySparkException as problem:
        reason = str(problem).splitlines()[0]
        raise UnusableTransform(f"unsupported pattern: {reason}") from None
    return compiled, java


def _java_literal(word: str) -> str:
    return "".join(ch if ch.isalnum() or ch == " " else "\\" + ch for ch in word)


def titlecase(c: Column) -> Column:
    """Every run of letters starts upper-case, also after apostrophes and digits."""
    runs = F.regexp_extract_all(c, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, F.initcap), "")


def _regex_replace(c: Column, options: Mapping) -> Column:
    compiled, java = _compiled(options)
    replacement = options.get("replacement", options.get("repl", ""))
    try:
        compiled.sub(replacement, "")  # Python's reader of replacements decides
    except (re.error, IndexError, TypeError) as problem:
        raise UnusableTransform(str(problem)) from None
    return F.regexp_replace(c, java, java_replacement(replacement, compiled.groupindex))


def _regex_extract(c: Column, options: Mapping) -> Column:
    compiled, java = _compiled(options)
    group = options.get("group", 0)
    if isinstance(group, str):
        group = compiled.groupindex.get(group, -1)
    if not 0 <= group <= compiled.groups:
        raise UnusableTransform("no such group", lambda v: v.rlike(java))
    return F.when(c.rlike(java), F.regexp_extract(c, java, group))


def _strip_prefix(c: Column, options: Mapping) -> Column:
    prefix = options.get("value", options.get("prefix", ""))
    if not prefix:
        return c
    return F.when(c.startswith(prefix), F.substr(c, F.lit(len(prefix) + 1))).otherwise(c)


def _strip_suffix(c: Column, options: Mapping) -> Column:
    suffix = options.get("value", options.get("suffix", ""))
    if not suffix:
        return c
    return F.when(
        c.endswith(suffix), F.substr(c, F.lit(1), F.length(c) - len(suffix))
    ).otherwise(c)


TRANSFORMS: dict[str, Transform] = {
    "trim": lambda c, o: strip(c),
    "collapse_whitespace": lambda c, o: clean_whitespace(c),
    "lowercase": lambda c, o: F.lower(c),
    "uppercase": lambda c, o: F.upper(c),
    "titlecase": lambda c, o: titlecase(c),
    "regex_replace": _regex_replace,
    "regex_extract": _regex_extract,
    "strip_prefix": _strip_prefix,
    "strip_suffix": _strip_suffix,
}


def register_transform(name: str, transform: Transform) -> None:
    """Add or replace a named transform."""
    TRANSFORMS[name] = transform


def null_empty(c: Column, empty_like: Sequence[str]) -> Column:
    """Null for blank and empty-like text; other text is not trimmed."""
    words = [_java_literal(w) for w in empty_like if w and w == w.strip()]
    choices = "|".join([*words, ""])
    # One anchored test that gives up at the first character of ordinary text.
    pattern = rf"(?iu)\A{WHITESPACE_CLASS}*+(?:{choices}){WHITESPACE_CLASS}*+\z"
    return F.when(~c.rlike(pattern), c)


def apply_chain(
    c: Column, transforms: Sequence[Mapping], empty_like: Sequence[str]
) -> tuple[Column, list[tuple[str, Column]]]:
    """The processed value and, per unusable step, (message, 0/1 flag)."""
    value = null_empty(c, empty_like)
    issues: list[tuple[str, Column]] = []
    for options in transforms:
        name = options.get("name")
        if not name:
            continue
        if name == "default_if_empty":
            if options.get("value") is not None:
                value = F.coalesce(value, F.lit(str(options["value"])))
        elif name not in TRANSFORMS:
            message = f"Unknown transform '{name}' skipped."
            issues.append((message, value.isNotNull().cast("int")))
            continue
        else:
            step = TRANSFORMS[name]
            try:
                value = let(value, lambda v: step(v, options))
            except UnusableTransform as problem:
                message = f"Transform '{name}' failed safely: {problem}"
                flag = value.isNotNull() & problem.when(value)
                issues.append((message, F.coalesce(flag, F.lit(False)).cast("int")))
                continue
        value = let(value, lambda v: null_empty(v, empty_like))
    return value, issues
