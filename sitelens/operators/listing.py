"""Listing records of directory pages and profile links of rendered ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.functions import text
from sitelens.operators.css import compile_selector
from sitelens.operators.extract import (
    Page,
    css_values,
    pick,
    value_needs,
    with_default,
)
from sitelens.operators.shred import NodeNeeds
from sitelens.plans.spec import FieldSpec


def listing_needs(record_selector: str | None, fields: Sequence[FieldSpec]) -> NodeNeeds:
    if not record_selector:
        raise ValueError("Listing pages need extraction.record_selector.css")
    needs = compile_selector(record_selector).needs()
    for field in fields:
        if field.selector:
            needs |= compile_selector(field.selector).needs() | value_needs(field.attribute)
    return needs


def listing_records(page: Page, record_selector: str, fields: Sequence[FieldSpec]) -> Column:
    """array<struct<fields>>, one entry per container, in document order.

    Nodes are in document order, so what a container holds is one slice of them.
    """
    containers = compile_selector(record_selector)

    def record(container: Column) -> Column:
        inside = F.slice(page.nodes, container.pos + 2, container.last - container.pos)

        def build(scope: Column) -> Column:
            values = []
            for field in fields:
                if field.selector:
                    found = css_values(
                        page, compile_selector(field.selector), field.attribute, page.url, scope
                    )
                    value = pick(found, field.many)
                else:
                    value = F.lit(None).cast("array<string>" if field.many else "string")
                values.append(with_default(value, field, field.many).alias(field.name))
            return F.struct(*values)

        return text.let(inside, build)

    found = F.filter(page.nodes, lambda n: containers.matches(n))
    return F.transform(found, record)


def profile_links(page: Page, selector: str) -> Column:
    """Distinct absolute profile URLs of a rendered directory page."""
    return css_values(page, compile_selector(selector), "href", page.url)


def profile_records(page: Page, selector: str, url_field: str) -> Column:
    """Profile links as listing records."""
    names = list(dict.fromkeys([url_field, "profile_url"]))
    return F.transform(
        profile_links(page, selector), lambda u: F.struct(*[u.alias(n) for n in names])
    )


def explode_records(pages: DataFrame, keep: Sequence[str], records: str = "records") -> DataFrame:
    """One row per record with its position on the page."""
    return pages.select(*keep, F.posexplode(records).alias("rec_idx", "__r")).select(
        *keep, "rec_idx", "__r.*"
    )
