"""Secret scans: one automaton for all rules, one byte pass per text.

The expressions of all rules are compiled together (see ``automaton``), each read from
its end, and the texts are scanned from their ends: the automaton is then in a state with
a rule's mark exactly where a match of that rule begins. Of the beginnings of a rule the
leftmost counts, its match is as long as possible, and the next one begins after it; a
match is dropped when it, or the part that the rule names, is too short. Only the bytes
of matches are read a second time, for their ends.

Nothing is shuffled: a text is scanned where it lies, in chunks whatever its length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.llm import automaton as dfa
from sitelens.llm.tokens import blocks, utf8


class Rule(NamedTuple):
    kind: str
    pattern: str
    least: int = 1  # bytes of a match, or of what follows ``head`` in it
    head: str | None = None  # expression of what comes before the part that is measured
    fold: bool = False  # letters in either case


_ASSIGN = """(password|passwd|secret|token|api_?key)["']?\\x20*[:=]\\x20*["']?"""
# A word of one class that must be long is matched as such: its runs are the matches.
BASE_RULES = (
    Rule("assign", _ASSIGN + "([A-Za-z0-9+/_.=-]+)", 6, _ASSIGN, True),
    Rule("access", "AKIA[A-Z0-9]+", 20),
    Rule("hex", "[0-9a-f]{24,}", 24),
)
MORE_RULES = (
    Rule("forge", "gh[oprsu]_[A-Za-z0-9]+", 40),
    Rule("chat", "xox[abprs]-[A-Za-z0-9-]+", 20),
    Rule("cloud", "AIza[A-Za-z0-9_-]+", 39),
    Rule("payment", "[rs]k_(live|test)_[A-Za-z0-9]+", 24),
    Rule("jwt", "eyJ[A-Za-z0-9_-]+\\.eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+", 40),
    Rule("pem", "-----BEGIN ([A-Z0-9]+ )*PRIVATE KEY-----"),
)
RULES = BASE_RULES + MORE_RULES


class Scanner:
    """The compiled rules. ``find`` gives the matches of many texts at once."""

    def __init__(self, rules: Sequence[Rule] = RULES) -> None:
        if len({r.kind for r in rules}) < len(rules) or len(rules) > 62:
            raise ValueError("Rules need kinds of their own, at most 62 of them.")
        trees = [dfa.parse(r.pattern, r.fold) for r in rules]
        self.rules = tuple(rules)
        self.begins = dfa.build([dfa.reversed_tree(t) for t in trees], anywhere=True)
        self.whole = [dfa.Anchored(t) for t in trees]
        self.heads = [dfa.Anchored(dfa.parse(r.head, r.fold)) if r.head else None for r in rules]

    def find(self, data: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(row, first byte, rule, end byte) of the rows ``data[at[i]:at[i + 1]]``, in
        order of row, start and rule; bytes count from the start of the row."""
        gap = self.begins.width - 1
        cuts = at[1:-1]
        classes = np.insert(self.begins.classes[data], cuts, gap)
        found = list(dfa.scan(self.begins, classes[::-1]))
        if not found:
            return []
        place = (len(classes) - 1 - np.concatenate([p for p, _ in found]))[::-1]
        marks = np.concatenate([m for _, m in found])[::-1]
        row_of = np.searchsorted(cuts + np.arange(1, len(cuts) + 1), place, "right")
        start = place - row_of  # without the gaps
        out = []
        for k, rule in enumerate(self.rules):
            mine = np.flatnonzero(marks >> k & 1)
            if not len(mine):
                continue
            rows, starts = row_of[mine], start[mine]
            firsts = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
            for lo, hi in zip(firsts, np.append(firsts[1:], len(rows)), strict=True):
                row = int(rows[lo])
                text = data[at[row] : at[row + 1]].tobytes()
                here = starts[lo:hi] - at[row]
                out += [(row, s, k, e) for s, e in self._matches(k, rule, text, here)]
        return sorted(out)

    def _matches(self, k: int, rule: Rule, text: bytes, starts: np.ndarray) -> Iterator[tuple[int, int]]:
        next_one = 0
        while next_one < len(starts):
            start = int(starts[next_one])
            end = self.whole[k].longest(text, start)
            measured = self.heads[k].longest(text, start) if rule.head else start
            if end - measured >= rule.least:
                yield start, end
            next_one = int(np.searchsorted(starts, max(end, start + 1)))


def find_secrets(docs: DataFrame, rules: Sequence[Rule] = RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id`` and ``spans``, an array of (kind, start, end).

    Positions are code points, ends are exclusive; spans are in order of start, then of
    the rules. Matches of different rules may overlap, those of one rule never do.
    A null or empty text has no spans; a null id stays null; repeated rows give a row
    each; other columns are not read. Case is told apart unless a rule folds ASCII letters.
    """
    scanner = Scanner(rules)
    kinds = np.array([r.kind for r in rules], object)
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                data, at = utf8(part.column("text"))
                found = scanner.find(data, at)
                rows = np.array([f[0] for f in found], np.int64)
                spans = np.zeros((len(found), 2), np.int32)
                for lo, hi in _runs(rows):
                    row = rows[lo]
                    # Bytes that begin a code point, up to each place of the row.
                    begins = np.zeros(at[row + 1] - at[row] + 1, np.int32)
                    np.cumsum((data[at[row] : at[row + 1]] & 0xC0) != 0x80, out=begins[1:])
                    for i in range(lo, hi):
                        spans[i] = begins[found[i][1]], begins[found[i][3]]
                offsets = np.searchsorted(rows, np.arange(part.num_rows + 1)).astype(np.int32)
                items = pa.StructArray.from_arrays(
                    [
                        pa.array(kinds[[f[2] for f in found]].tolist(), pa.string()),
                        pa.array(spans[:, 0]),
                        pa.array(spans[:, 1]),
                    ],
                    ["kind", "start", "end"],
                )
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), items)],
                    ["doc_id", "spans"],
                )

    return source.mapInArrow(
        run, f"doc_id {id_type}, spans array<struct<kind:string, start:int, end:int>>"
    )


def _runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, end) of each stretch of equal values."""
    if len(values):
        firsts = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
        yield from zip(firsts.tolist(), [*firsts[1:].tolist(), len(values)], strict=True)


def span_digest(found: DataFrame, base: Sequence[str] = tuple(r.kind for r in BASE_RULES)) -> DataFrame:
    """What ``find_secrets`` found as counts of the base kinds, a hash of their spans, and
    all spans as text (``kind:start:end``, comma-joined)."""

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")

    def of(*kinds):
        return F.filter("spans", lambda s: s.kind.isin(*kinds))

    return found.select(
        "doc_id",
        *[F.size(of(kind)).cast("bigint").alias(f"n_{kind}") for kind in base],
        F.sha2(joined(of(*base)).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
