"""Merging page records into one record per seed, and the contact summary.

List fields are reduced to distinct items before anything is gathered: an item
leaves a map task once per seed, and what is gathered per seed is exactly the
array that the merged row holds. A seed has at most ``crawl.max_pages`` pages.
``merge_items`` and ``merge_scalars`` give the same result in long form for keys
without such a bound, such as whole domains.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.functions import text, urls
from sitelens.operators.extract import default_value
from sitelens.plans.spec import FieldSpec


def merge_items(
    pages: DataFrame, keys: Sequence[str], order: str, lists: Sequence[str]
) -> DataFrame:
    """Distinct list items per key and field, with the page and place of first use.

    Grouping is on key, field and item, so a hot key spreads over its items and
    repeated items shrink on the map side. ``order`` is unique within a key.
    """
    entries = F.flatten(
        F.array(
            *[
                F.transform(
                    F.filter(F.coalesce(F.col(name), F.array().cast("array<string>")), lambda x: ~text.blank(x)),
                    lambda x, i: F.struct(
                        F.lit(name).alias("field"), text.strip(x).alias("item"), i.alias("pos")
                    ),
                )
                for name in lists
            ]
        )
    )
    return (
        pages.select(*keys, F.col(order).alias("__rank"), F.inline(entries))
        .filter(F.col("item") != "")
        .groupBy(*keys, "field", "item")
        # Primitive buffers keep this a hash aggregate.
        .agg(F.min("__rank").alias("first_rank"), F.min_by("pos", "__rank").alias("first_pos"))
    )


def merge_scalars(
    pages: DataFrame, keys: Sequence[str], order: str, scalars: Sequence[str]
) -> DataFrame:
    """First non-empty value of every scalar field per key, in page order."""
    return pages.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("pages_merged"),
        *[
            F.min_by(n, F.when(~text.blank(F.col(n)), F.col(order))).alias(n) for n in scalars
        ],
    )


def merge_pages(
    pages: DataFrame,
    key: str,
    order: str,
    fields: Mapping[str, bool],
    specs: Sequence[FieldSpec] = (),
) -> DataFrame:
    """One row per ``key``: scalars by first non-empty, lists by ordered union.

    ``fields`` maps each merged column to whether it is a list. ``specs`` supply
    defaults; a list field declared with ``many`` falls back to an empty list.
    """
    lists = [n for n, listed in fields.items() if listed]
    scalars = [n for n, listed in fields.items() if not listed]
    merged = merge_scalars(pages, [key], order, scalars)
    if lists:
        items = merge_items(pages, [key], order, lists)
        arrays = items.groupBy(key).agg(
            *[
                F.transform(
                    F.array_sort(
                        F.collect_list(
                            F.when(
                                F.col("field") == name,
                                F.struct("first_rank", "first_pos", "item"),
                            )
                        )
                    ),
                    lambda e: e.item,
                ).alias(name)
                for name in lists
            ]
        )
        merged = merged.join(arrays, key, "left")
    by_name = {f.name: f for f in specs}
    columns = []
    for name, listed in fields.items():
        value = F.col(name)
        if listed:
            value = F.when(F.size(value) > 0, value)
            field = by_name.get(name)
            fallback = default_value(field, True) if field else None
            if fallback is None and (field is None or field.many):
                fallback = F.array().cast("array<string>") if field else None
            value = value if fallback is None else F.coalesce(value, fallback)
        elif name in by_name:
            fallback = default_value(by_name[name], False)
            value = value if fallback is None else F.coalesce(value, fallback)
        columns.append(value.alias(name))
    return merged.select(key, *columns)


# -- contact summary ------------------------------------------------------------

# Mailbox names in order of preference.
PREFERRED_MAILBOXES = ["info", "contact", "hello", "intake", "office", "admin", "support"]


def _best(values: Column, rank) -> Column:
    """The value with the greatest rank; the first of equals."""
    ranked = F.transform(
        values, lambda v, i: F.struct(rank(v).alias("rank"), (-i).alias("i"), v.alias("v"))
    )
    return F.array_max(ranked).v


def best_contact_email(emails: Column, seed_url: Column) -> Column:
    host = urls.hostname(seed_url)
    bare = F.regexp_replace(host, r"^www\.", "")

    def rank(email: Column) -> Column:
        def parts(e: Column) -> Column:
            mailbox = F.substring_index(e, "@", 1)
            domain = F.when(e.contains("@"), F.substr(e, F.instr(e, "@") + 1)).otherwise("")
            preference = F.lit(0)
            for place, name in reversed(list(enumerate(PREFERRED_MAILBOXES))):
                preference = F.when(
                    mailbox.startswith(name), F.lit(len(PREFERRED_MAILBOXES) - place)
                ).otherwise(preference)
            own = ((domain == host) | (domain == bare)).cast("int")
            return F.struct(preference.alias("p"), own.alias("d"), e.alias("e"))

        return text.let(F.lower(text.strip(email)), parts)

    return _best(emails, rank)


def _page_rank(score) -> object:
    return lambda url: text.let(
        F.lower(url),
        lambda low: F.struct(
            score(low).alias("s"), (-F.length(url)).alias("l"), low.alias("u")
        ),
    )


def best_contact_page(pages: Column) -> Column:
    return _best(
        pages,
        _page_rank(
            lambda u: F.when(u.contains("/contact") | u.contains("contact-us"), 3)
            .when(u.contains("/about"), 2)
            .when(u.contains("/team") | u.contains("/staff"), 1)
            .otherwise(0)
        ),
    )


def best_email_page(sources: Column, contact_pages: Column) -> Column:
    known = F.transform(F.coalesce(contact_pages, F.array().cast("array<string>")), F.lower)
    return _best(
        sources,
        _page_rank(
            lambda u: F.when(F.array_contains(known, u), 3)
            .when(u.contains("/contact") | u.contains("contact-us"), 2)
            .when(u.contains("/about") | u.contains("/team"), 1)
            .otherwise(0)
        ),
    )


def contact_summary(rows: DataFrame, seed: str = "input_url") -> DataFrame:
    """Add the best e-mail, contact page, e-mail page and phone of each row."""
    empty = F.array().cast("array<string>")

    def listed(name: str) -> Column:
        if name not in rows.columns:
            return empty
        if rows.schema[name].dataType.simpleString() == "string":
            items = F.array(F.col(name))
        else:
            items = F.coalesce(F.col(name), empty)
        return F.filter(items, lambda x: ~text.blank(x))

    emails, pages = listed("emails"), listed("contact_pages")
    sources, phones = listed("email_source_urls"), listed("phones")
    return rows.withColumns(
        {
            "email": best_contact_email(emails, F.col(seed)),
            "contact_page_url": best_contact_page(pages),
            "email_found_on": best_email_page(sources, pages),
            "contact_phone": text.first_item(phones),
        }
    ).drop("email_source_urls", "phone_source_urls")
