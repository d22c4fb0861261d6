"""CSS selectors as predicates over shredded nodes.

The page reader matches selectors while it reads (see ``matching``) and lists on each
node the selectors that it satisfies; a predicate only looks that up.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitelens.operators.matching import parse
from sitelens.operators.shred import NodeNeeds


@dataclass(frozen=True)
class Selector:
    source: str

    def matches(self, node: Column) -> Column:
        return F.array_contains(node.hits, F.lit(self.source))

    def needs(self) -> NodeNeeds:
        return NodeNeeds(selectors=frozenset([self.source]))


def compile_selector(source: str) -> Selector:
    """Refuses unsupported selectors while the plan is built."""
    parse(source)
    return Selector(source)
