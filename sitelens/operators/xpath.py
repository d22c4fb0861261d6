"""XPath fields over the well-formed copy of a page.

Spark's own ``xpath`` functions evaluate the path, with all axes, predicates, functions
and unions. They cannot return the texts of many elements: such a path is rewritten as a
CSS selector where it is simple, and else run on a copy in which each element carries its
place in the node array, so that the path returns places.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext

from sitelens.functions.text import WHITESPACE
from sitelens.operators.shred import NUMBER

_STEP = re.compile(r"(//?)([A-Za-z][\w\-]*|\*)((?:\[[^\[\]]*\])*)")
_TEST = re.compile(
    r"""\[\s*(?:(?P<place>\d+|last\(\))|@(?P<has>[\w:\-]+)(?:\s*=\s*(?P<is>'[^']*'|"[^"]*"))?"""
    r"""|(?P<call>contains|starts-with)\(\s*@(?P<of>[\w:\-]+)\s*,\s*(?P<part>'[^']+'|"[^"]+")\s*\))\s*\]"""
)


# Functions whose value is no set of nodes.
_SCALARS = frozenset(
    "boolean ceiling concat contains count false floor lang last local-name name namespace-uri "
    "normalize-space not number position round starts-with string string-length substring "
    "substring-after substring-before sum translate true".split()
)
_BLANK = f"normalize-space(translate(., '{WHITESPACE}', '{' ' * len(WHITESPACE)}'))"


def _outside(path: str) -> Iterator[tuple[int, str]]:
    """(place, character) of what is outside brackets, parentheses and quotes."""
    depth, quote = 0, ""
    for at, char in enumerate(path):
        if quote:
            quote = "" if char == quote else quote
            continue
        if char in "'\"":
            quote = char
        elif char in "[(":
            if not depth:
                yield at, char
            depth += 1
            continue
        elif char in "])":
            depth -= 1
            if depth:
                continue
        if not depth:
            yield at, char


def _split(path: str, sign: str) -> list[str]:
    """The parts of a path between signs that are outside of everything."""
    parts, start = [], 0
    for at, char in _outside(path):
        if char == sign:
            parts.append(path[start:at])
            start = at + 1
    return [part.strip() for part in [*parts, path[start:]]]


def _unwrapped(path: str) -> str:
    """``a | b`` of ``(a | b)[1]``; other paths as they are."""
    path = path.strip()
    while path.startswith("("):
        outer = [(at, char) for at, char in _outside(path)]
        close = outer[1][0] if len(outer) > 1 and outer[1][1] == ")" else -1
        rest = "".join(char for at, char in outer if at > close).strip() if close > 0 else "?"
        if rest.replace("[]", "").strip():
            break
        path = path[1:close].strip()
    return path


def is_scalar(path: str) -> bool:
    """Whether a path gives a string, a number or a truth value in place of nodes."""
    inner = _unwrapped(path)
    call = re.match(r"([a-z][a-z\-]*)\s*\(", inner)
    if inner[:1] in "'\"" or inner[:1].isdigit() or (call and call[1] in _SCALARS):
        return True
    flat = "".join(char for _, char in _outside(inner))
    return bool(re.search(r"[=<>+]|\s-\s|[\s\])](and|or|div|mod)[\s\[(]", flat))


def _kind(path: str) -> str:
    """What a path without unions at the top selects: strings, elements or mixed nodes."""
    inner = _unwrapped(path)
    kinds = {_kind(part) for part in _split(inner, "|")} if len(_split(inner, "|")) > 1 else set()
    if kinds:
        return kinds.pop() if len(kinds) == 1 else "mixed"
    step = _split(inner, "/")[-1]
    axis, _, test = step.rpartition("::") if re.match(r"[a-z\-]+\s*::", step) else ("", "", step)
    test = test.strip()
    if axis.strip() == "attribute" or test.startswith("@"):
        return "strings"
    if re.match(r"(text|comment|processing-instruction)\s*\(", test):
        return "strings"
    return "mixed" if re.match(r"node\s*\(", test) else "elements"


def selects_strings(path: str) -> bool:
    """Whether a path ends in attributes or text nodes."""
    return _kind(path) == "strings"


def check(path: str) -> None:
    """ValueError for what is no path, while the plan is built."""
    context = SparkContext._active_spark_context
    try:
        context._jvm.javax.xml.xpath.XPathFactory.newInstance().newXPath().compile(path)
    except Py4JJavaError as error:
        raise ValueError(f"XPath {path!r} cannot be read: {error.java_exception.getMessage()}") from error


def first_filled(path: str) -> str:
    """The first node of a path whose text is not blank."""
    own = f"[not(self::processing-instruction('{NUMBER}'))]" if _kind(path) == "mixed" else ""
    return f"({path}){own}[{_BLANK}][1]"


def numbered(path: str) -> str:
    """The same nodes in a numbered page: strings as they are, elements by their numbers."""
    parts = []
    for part in _split(path, "|"):
        kind = _kind(part)
        if kind != "strings":
            parts.append(f"({part})/processing-instruction('{NUMBER}')")
        if kind == "mixed":
            own = f"({part})[not(self::processing-instruction('{NUMBER}'))]"
            parts.append(f"{own}[self::text() or count(. | ../@*) = count(../@*)]")
        if kind == "strings":
            parts.append(part)
    return " | ".join(parts)


def _tests_as_css(tag: str, tests: str) -> str | None:
    """Predicates of one step. A place counts the step's elements below one parent, so
    it must come before the tests that thin them out."""
    at, out = 0, []
    while at < len(tests):
        test = _TEST.match(tests, at)
        if not test or (test["place"] and at):
            return None
        if test["place"]:
            kind = "child" if tag == "*" else "of-type"
            last = test["place"] == "last()"
            out.append(f":last-{kind}" if last else f":nth-{kind}({test['place']})")
        elif test["has"]:
            out.append(f"[{test['has']}={test['is']}]" if test["is"] else f"[{test['has']}]")
        else:
            sign = "*=" if test["call"] == "contains" else "^="
            out.append(f"[{test['of']}{sign}{test['part']}]")
        at = test.end()
    return "".join(out)


def as_css(path: str) -> str | None:
    """An element path as a CSS selector, or None."""
    at, parts = 0, []
    text = path.strip()
    while at < len(text):
        step = _STEP.match(text, at)
        if not step or (not parts and step[1] != "//"):
            return None
        tests = _tests_as_css(step[2], step[3])
        if tests is None:
            return None
        if parts:
            parts.append(" > " if step[1] == "/" else " ")
        parts.append(step[2].lower() + tests)
        at = step.end()
    return "".join(parts) or None
