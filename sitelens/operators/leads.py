"""Lead cleaning: filter, project, key, group duplicates, keep the best, sort.

Group winners come from ``max_by`` aggregates, which shrink on the map side, so a
group that holds a large part of all rows never meets in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelens.functions import contacts, text, urls
from sitelens.operators.components import connected_components
from sitelens.operators.records import is_list
from sitelens.operators.skew import cut_lineage, salted_join

# Defaults and the field names the cleaning rules look at.
SORT_FIELDS = ["firm", "email"]
JUNK_EMAIL_SUBSTRINGS = ["sentry.io", "wixpress.com", "ingest.sentry", "@example.com", "johndoe"]
URL_FIELDS = ["website", "url", "contact_page_url", "profile_url", "source_directory", "input_url"]
SCORED_FIELDS = [
    "email", "url", "website", "firm", "law_firm", "company", "name", "contact_page_url",
    "profile_url", "source_directory", "contact_phone", "phone", "phones",
]
EMAIL_KEY_FIELDS = ["email", "contact_email"]
DOMAIN_KEY_FIELDS = ["website", "url", "input_url"]
PHONE_KEY_FIELDS = ["contact_phone", "phone", "phones"]
COMPANY_KEY_FIELDS = ["firm", "law_firm", "company", "name"]


@dataclass
class LeadSettings:
    rename_fields: dict[str, str] = field(default_factory=dict)
    include_fields: list[str] = field(default_factory=list)
    required_fields: list[str] = field(default_factory=list)
    sort_fields: list[str] = field(default_factory=lambda: list(SORT_FIELDS))
    junk_email_substrings: list[str] = field(default_factory=lambda: list(JUNK_EMAIL_SUBSTRINGS))


def read_settings(options: Mapping | LeadSettings | None) -> LeadSettings:
    if isinstance(options, LeadSettings):
        return options
    options = options or {}
    renames = options.get("rename_fields", {})
    if not isinstance(renames, Mapping):
        raise ValueError("rename_fields must be an object")
    lists = {}
    for key in ("include_fields", "required_fields", "sort_fields", "junk_email_substrings"):
        value = options.get(key)
        if value is not None and not isinstance(value, (list, tuple)):
            raise ValueError(f"{key} must be a list")
        if value is not None:
            lists[key] = [str(v).strip() for v in value if str(v).strip()]
    lists["sort_fields"] = lists.get("sort_fields") or list(SORT_FIELDS)
    if "junk_email_substrings" in lists:
        lists["junk_email_substrings"] = [v.lower() for v in lists["junk_email_substrings"]]
    names = {str(a): str(b) for a, b in renames.items() if str(a).strip() and str(b).strip()}
    return LeadSettings(rename_fields=names, **lists)


def strip_strings(df: DataFrame) -> DataFrame:
    """Strip string values and the items of string lists."""
    columns = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.StringType):
            c = text.strip(c).alias(f.name)
        elif is_list(df, f.name):
            c = F.transform(c, text.strip).alias(f.name)
        columns.append(c)
    return df.select(*columns)


def _text_fields(df: DataFrame, names: Sequence[str]) -> list[str]:
    return [n for n in names if n in df.columns and isinstance(df.schema[n].dataType, T.StringType)]


def _first_text(df: DataFrame, names: Sequence[str]) -> Column:
    """First non-blank string among the named columns, else ""."""
    values = [F.when(~text.blank(text.strip(F.col(n))), text.strip(F.col(n))) for n in _text_fields(df, names)]
    return F.coalesce(*values, F.lit(""))


def lead_status(df: DataFrame, settings: LeadSettings) -> Column:
    """missing_required, junk_email or kept, for stripped rows."""
    missing = F.lit(False)
    for name in settings.required_fields:
        if name not in df.columns:
            missing = F.lit(True)
        else:
            missing = missing | text.is_empty(F.col(name), is_list(df, name))
    email = contacts.normalize_email(_first_text(df, ["email"]))
    junk = F.lit(False)
    for token in settings.junk_email_substrings:
        junk = junk | email.contains(token)
    return (
        F.when(missing, F.lit("missing_required")).when(junk, F.lit("junk_email")).otherwise(F.lit("kept"))
    )


def url_texts(df: DataFrame, settings: LeadSettings, skip: Sequence[str] = ()) -> list[str]:
    """String columns that hold URLs after renaming."""
    return [
        n
        for n in _text_fields(df, [c for c in df.columns if c not in skip])
        if settings.rename_fields.get(n, n) in URL_FIELDS
    ]


def with_urls(df: DataFrame, settings: LeadSettings, skip: Sequence[str] = ()) -> DataFrame:
    """Add ``__urls``: the normalized URL columns, then the URL of the domain key.

    One pass of one expression normalizes all of them.
    """
    values = [F.col(n) for n in url_texts(df, settings, skip)]
    return df.withColumn(
        "__urls",
        F.transform(F.array(*values, _first_text(df, DOMAIN_KEY_FIELDS)), lambda u: urls.normalize_url(u)),
    )


def project_columns(df: DataFrame, settings: LeadSettings, skip: Sequence[str] = ()) -> dict[str, Column]:
    """Renamed, normalized output columns; later columns win a shared name.

    ``df`` has stripped values and ``__urls``.
    """
    columns: dict[str, Column] = {}
    places = {n: i for i, n in enumerate(url_texts(df, settings, skip))}
    for f in df.schema.fields:
        if f.name in skip or f.name == "__urls":
            continue
        target = settings.rename_fields.get(f.name, f.name)

        def normalize(c: Column, target: str = target) -> Column:
            if target == "email":
                return contacts.normalize_email(c)
            if target in URL_FIELDS:
                return urls.normalize_url_value(text.strip(c))
            return text.strip(c)

        c = F.col(f.name)
        if f.name in places:
            found = F.coalesce(F.get("__urls", F.lit(places[f.name])), F.lower(c))
            columns[target] = F.when(c == "", c).when(c.isNotNull(), found)
        elif isinstance(f.dataType, T.StringType):
            columns[target] = F.when(c.isNotNull(), normalize(c))
        elif is_list(df, f.name):
            kept = F.filter(c, lambda x: ~text.blank(x))
            columns[target] = text.ordered_distinct(F.transform(kept, lambda x: normalize(x)))
        else:
            columns[target] = c
    if settings.include_fields:
        return {n: columns.get(n, F.lit("")) for n in settings.include_fields}
    return columns


def dedupe_keys(df: DataFrame, company: Column) -> Column:
    """struct(kind, keys): the first key class that a row can fill.

    ``df`` has stripped values and ``__urls``; ``company`` is the company text of
    the projected row.
    """
    email = contacts.normalize_email(_first_text(df, EMAIL_KEY_FIELDS))
    host = urls.canonical_domain(F.element_at("__urls", -1))
    domain = F.coalesce(urls.root_domain(host), F.lit(""))
    values = [
        F.col(n) if is_list(df, n) else F.array(F.col(n))
        for n in PHONE_KEY_FIELDS
        if n in df.columns
    ]
    phones = (
        contacts.normalize_phones(F.concat(*[F.coalesce(v, F.array().cast("array<string>")) for v in values]))
        if values
        else F.array().cast("array<string>")
    )
    name = contacts.normalize_company(company)

    def pair(kind: str, keys: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), keys.alias("keys"))

    none = F.array().cast("array<string>")
    return (
        F.when(email != "", pair("email", F.array(email)))
        .when(domain != "", pair("domain", F.array(domain)))
        .when(F.size(phones) > 0, pair("phone", phones))
        .when(name != "", pair("company", F.array(name)))
        .otherwise(pair("none", none))
    )


def completeness(columns: Mapping[str, tuple[Column, bool]]) -> Column:
    """(important fields filled, fields filled, total text length)."""
    important, total, length = F.lit(0), F.lit(0), F.lit(0)
    for name, (c, listed) in columns.items():
        filled = ~text.is_empty(c, listed)
        as_text = text.list_literal(c) if listed else text.strip(c.cast("string"))
        total = total + filled.cast("int")
        if name in SCORED_FIELDS:
            important = important + filled.cast("int")
        length = length + F.when(filled, F.length(as_text)).otherwise(0)
    return F.struct(important.alias("important"), total.alias("filled"), length.alias("length"))


def prepare_leads(leads: DataFrame, settings: LeadSettings, idx: str = "idx") -> DataFrame:
    """idx, status, kind, keys, score and the projected row as a struct."""
    stripped = strip_strings(leads)
    located = with_urls(stripped, settings, skip=[idx])
    source = located.withColumn("__status", lead_status(stripped.drop(idx), settings))
    projected = project_columns(located, settings, skip=[idx])
    staged = source.withColumn("__row", F.struct(*[c.alias(n) for n, c in projected.items()]))
    row_schema = staged.schema["__row"].dataType
    listed = {f.name: isinstance(f.dataType, T.ArrayType) for f in row_schema.fields}
    firms = [
        F.when(~text.blank(F.col(f"__row.{n}")), F.col(f"__row.{n}"))
        for n in COMPANY_KEY_FIELDS
        if n in listed and not listed[n]
    ]
    company = F.coalesce(*firms, F.lit(""))
    score = completeness({n: (F.col("__row")[n], is_l) for n, is_l in listed.items()})
    return staged.select(
        F.col(idx).alias("idx"),
        F.col("__status").alias("status"),
        dedupe_keys(stripped, company).alias("k"),
        score.alias("score"),
        F.col("__row").alias("row"),
    ).select("idx", "status", F.col("k.kind").alias("kind"), F.col("k.keys").alias("keys"), "score", "row")


def phone_components(prepared: DataFrame) -> DataFrame:
    """(node, component) over phones that share a row; lone phones are left out."""
    sets = prepared.filter((F.col("kind") == "phone") & (F.size("keys") > 1)).select("keys").distinct()
    edges = sets.select(
        F.col("keys")[0].alias("u"), F.explode(F.slice("keys", F.lit(2), F.size("keys"))).alias("v")
    )
    return connected_components(edges)


def with_groups(prepared: DataFrame, known_rows: int | None = None) -> DataFrame:
    """Add ``group_id``: rows with the same one are duplicates of each other.

    ``prepared`` is read several times, so it should be stored.
    """
    first = F.col("keys")[0]
    own = F.when(F.col("kind") == "none", F.concat(F.lit("row:"), F.col("idx").cast("string"))).otherwise(
        F.concat(F.col("kind"), F.lit(":"), first)
    )
    components = phone_components(prepared).select(
        F.concat(F.lit("phone:"), "node").alias("__own"), "component"
    )
    return (
        salted_join(
            prepared.withColumn("__own", own), components, ["__own"], "left", known_rows=known_rows
        )
        .withColumn(
            "group_id",
            F.coalesce(F.concat(F.lit("phone:"), F.col("component")), F.col("__own")),
        )
        .drop("__own", "component")
    )


def best_rows(grouped: DataFrame) -> DataFrame:
    """Per group: the most complete row, its index, group size and first index."""
    rank = F.struct(F.col("score"), (-F.col("idx")).alias("earlier"))
    return grouped.groupBy("group_id").agg(
        F.max_by("row", rank).alias("row"),
        F.max_by("idx", rank).alias("best_idx"),
        F.count(F.lit(1)).alias("group_size"),
        F.min("idx").alias("first_idx"),
    )


@dataclass
class CleanLeads:
    rows: DataFrame
    stats: DataFrame
    prepared: DataFrame
    best: DataFrame


def clean_leads(
    leads: DataFrame, settings: Mapping | LeadSettings | None = None, idx: str | None = None
) -> CleanLeads:
    """Filter, project and deduplicate leads; sorted rows and their counters.

    ``idx`` names an input-order column; without it the read order counts.
    """
    settings = read_settings(settings)
    if idx is None:
        idx = "__idx"
        leads = leads.withColumn(idx, F.monotonically_increasing_id())
    prepared = cut_lineage(prepare_leads(leads, settings, idx))
    kept = prepared.filter("status = 'kept'")
    best = cut_lineage(best_rows(with_groups(kept, kept.count())))
    row_type = best.schema["row"].dataType

    def sort_key(name: str) -> Column:
        if name not in row_type.fieldNames():
            return F.lit("")
        c = F.col("row")[name]
        if isinstance(row_type[name].dataType, T.ArrayType):
            c = F.when(F.size(c) > 0, text.list_literal(c))
        return F.lower(F.coalesce(c.cast("string"), F.lit("")))

    rows = best.orderBy(*[sort_key(n) for n in settings.sort_fields], "first_idx").select("row.*")
    counted = prepared.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(F.col("status") == "missing_required").alias("filtered_missing_required"),
        F.count_if(F.col("status") == "junk_email").alias("filtered_junk_email"),
        F.lit(1).alias("__all"),
    )
    written = best.agg(
        F.coalesce(F.sum(F.col("group_size") - 1), F.lit(0)).alias("duplicates_removed"),
        F.count(F.lit(1)).alias("written"),
        F.lit(1).alias("__all"),
    )
    return CleanLeads(rows, counted.join(written, "__all").drop("__all"), prepared, best)
