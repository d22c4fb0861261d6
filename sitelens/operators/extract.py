"""Field extraction: builtin extractors, CSS selectors and XPath.

``extract_fields`` works in three steps. Fields that only need the raw HTML are
computed first, on the JVM; then pages are shredded once with the node needs of
all other fields; then those fields become expressions over the shredded arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.functions import contacts, text, urls
from sitelens.operators import xpath as xp
from sitelens.operators.css import Selector, compile_selector
from sitelens.operators.shred import MARK, OWN_TEXT_TAGS, NodeNeeds, shred
from sitelens.plans.spec import FieldSpec

# Hosts of social profiles, and words that mark a contact page.
SOCIAL_DOMAINS = [
    "facebook.com", "instagram.com", "linkedin.com", "twitter.com", "x.com",
    "youtube.com", "tiktok.com",
]
CONTACT_KEYWORDS = ["contact", "about", "team", "staff", "office", "location", "get-in-touch"]
ADDRESS_SELECTOR = (
    "address, [itemprop='address'], .address, .location, .contact-address, .footer-address"
)
DESCRIPTION_SELECTOR = "meta[name='description'], meta[property='og:description']"
SITE_NAME_SELECTOR = "meta[property='og:site_name']"


@dataclass(frozen=True)
class Page:
    """The columns of a shredded page that extractors may use."""

    url: Column
    nodes: Column
    texts: Column
    xhtml: Column
    raw: dict  # raw-HTML values computed before the shred, by name
    links: Column


def node_text(texts: Column, node: Column) -> Column:
    """Element text: pieces joined by single spaces."""
    pieces = F.slice(texts, node.t0 + 1, node.t1 - node.t0)
    joined = F.array_join(F.transform(pieces, lambda x: F.trim(x)), " ")
    return F.when(node.tag.isin(sorted(OWN_TEXT_TAGS)), F.coalesce(node.raw, F.lit(""))).otherwise(
        joined
    )


def node_content(texts: Column, node: Column) -> Column:
    """Element text with nothing put between adjacent pieces."""
    pieces = F.slice(texts, node.t0 + 1, node.t1 - node.t0)
    return F.trim(F.array_join(pieces, ""))


def node_value(
    texts: Column, node: Column, attribute: str | None, base: Column | None = None
) -> Column:
    """Text or attribute of a node; links are resolved only when a base is given."""
    if not attribute or attribute in ("text", "text_content"):
        return node_text(texts, node)
    raw = F.coalesce(F.try_element_at(node.attrs, F.lit(attribute)), F.lit(""))
    if attribute in ("href", "src") and base is not None:
        return F.when(raw == "", raw).otherwise(urls.urljoin(base, raw))
    return text.clean_whitespace(raw)


def value_needs(attribute: str | None) -> NodeNeeds:
    if not attribute or attribute in ("text", "text_content"):
        return NodeNeeds(text=True)
    return NodeNeeds(attrs=frozenset([attribute]))


def css_values(
    page: Page,
    selector: Selector,
    attribute: str | None,
    base: Column | None = None,
    scope: Column | None = None,
) -> Column:
    """Distinct non-blank values of the matching nodes, in document order."""
    found = F.filter(
        page.nodes if scope is None else scope, lambda n: selector.matches(n)
    )
    values = F.transform(found, lambda n: node_value(page.texts, n, attribute, base))
    return text.ordered_distinct(values)


def pick(values: Column, many: bool) -> Column:
    return values if many else text.first_item(values)


@text.cached_by_name
def page_links(url: Column, nodes: Column, texts: Column) -> Column:
    """Followable links: array of (url, anchor) in document order."""
    origin = urls.url_origin(url)
    anchors = F.filter(
        nodes, lambda n: (n.tag == "a") & F.try_element_at(n.attrs, F.lit("href")).isNotNull()
    )
    hrefs = F.transform(
        anchors,
        lambda n: F.struct(
            text.strip(F.element_at(n.attrs, F.lit("href"))).alias("href"),
            node_text(texts, n).alias("anchor"),
        ),
    )
    kept = F.filter(hrefs, lambda h: ~urls.should_skip_url(h.href))
    links = F.transform(
        kept,
        lambda h: F.struct(
            urls.normalize_url(h.href, url, origin).alias("url"), h.anchor.alias("anchor")
        ),
    )
    return F.filter(links, lambda link: urls.is_http_url(link.url))


LINK_NEEDS = NodeNeeds(tags=frozenset(["a"]), attrs=frozenset(["href"]), text=True)


@dataclass(frozen=True)
class Extractor:
    """A named extractor: its expression, whether it is a list, what it needs."""

    build: Callable[[Page], Column]
    is_list: bool = False
    needs: NodeNeeds = NodeNeeds()
    raw: dict | None = None  # name -> expression over raw HTML
    links: bool = False


def _first_attr(page: Page, selector: str, attribute: str) -> Column:
    compiled = compile_selector(selector)
    nodes = F.filter(page.nodes, lambda n: compiled.matches(n))
    value = F.try_element_at(text.first_item(nodes).attrs, F.lit(attribute))
    return text.clean_whitespace(value)


def _title(page: Page) -> Column:
    node = text.first_item(F.filter(page.nodes, lambda n: n.tag == "title"))
    return text.let(
        node, lambda n: F.when(n.isNotNull() & (n.pos == n.last), node_text(page.texts, n))
    )


def _headings(page: Page) -> Column:
    found = F.filter(page.nodes, lambda n: n.tag.isin("h1", "h2", "h3"))
    return text.ordered_distinct(F.transform(found, lambda n: node_text(page.texts, n)))


def _link_urls(page: Page, keep: Callable[[Column], Column]) -> Column:
    return text.ordered_distinct(F.transform(F.filter(page.links, keep), lambda k: k.url))


def _mentions(words: Sequence[str], *where: Column) -> Column:
    verdict = F.lit(False)
    for word in words:
        for c in where:
            verdict = verdict | c.contains(word)
    return verdict


def _internal_links(page: Page) -> Column:
    own = urls.canonical_domain(page.url)
    return _link_urls(page, lambda k: urls.canonical_domain(k.url) == own)


def _contact_links(page: Page) -> Column:
    own = urls.canonical_domain(page.url)
    return _link_urls(
        page,
        lambda k: _mentions(CONTACT_KEYWORDS, F.lower(k.url), F.lower(k.anchor))
        & (urls.canonical_domain(k.url) == own),
    )


def _social_links(page: Page) -> Column:
    return _link_urls(page, lambda k: _mentions(SOCIAL_DOMAINS, F.lower(k.url)))


def _address(page: Page) -> Column:
    candidates = css_values(page, compile_selector(ADDRESS_SELECTOR), None)
    return F.coalesce(contacts.extract_address(F.lit(""), candidates), page.raw["address"])


def _business_name(page: Page) -> Column:
    site = _first_attr(page, SITE_NAME_SELECTOR, "content")
    return F.coalesce(
        text.null_if_empty(site, False),
        contacts.derive_business_name(_title(page), _headings(page)),
    )


_HEADING_NEEDS = NodeNeeds(tags=frozenset(["h1", "h2", "h3"]), text=True)
_TITLE_NEEDS = NodeNeeds(tags=frozenset(["title"]), text=True)
_CONTENT = NodeNeeds(attrs=frozenset(["content"]))
_EMAILS = Extractor(lambda p: p.raw["emails"], True, raw={"emails": text.extract_emails})
_PHONES = Extractor(lambda p: p.raw["phones"], True, raw={"phones": text.extract_phones})

EXTRACTORS: dict[str, Extractor] = {
    "page_title": Extractor(_title, needs=_TITLE_NEEDS),
    "meta_description": Extractor(
        lambda p: _first_attr(p, DESCRIPTION_SELECTOR, "content"),
        needs=compile_selector(DESCRIPTION_SELECTOR).needs() | _CONTENT,
    ),
    "emails": _EMAILS,
    "email": _EMAILS,
    "phone_numbers": _PHONES,
    "phones": _PHONES,
    "phone": _PHONES,
    "headings": Extractor(_headings, True, needs=_HEADING_NEEDS),
    "internal_links": Extractor(_internal_links, True, needs=LINK_NEEDS, links=True),
    "contact_links": Extractor(_contact_links, True, needs=LINK_NEEDS, links=True),
    "social_links": Extractor(_social_links, True, needs=LINK_NEEDS, links=True),
    "address": Extractor(
        _address,
        needs=compile_selector(ADDRESS_SELECTOR).needs() | NodeNeeds(text=True),
        raw={"address": contacts.address_in_text},
    ),
    "business_name": Extractor(
        _business_name,
        needs=_HEADING_NEEDS | _TITLE_NEEDS | _CONTENT | compile_selector(SITE_NAME_SELECTOR).needs(),
    ),
}


def register_extractor(name: str, extractor: Extractor) -> None:
    """Add or replace a named extractor."""
    EXTRACTORS[name] = extractor


def is_list_field(field: FieldSpec) -> bool:
    if field.type:
        if field.type not in EXTRACTORS:
            raise ValueError(f"Unknown extractor type: {field.type}")
        return EXTRACTORS[field.type].is_list
    return field.many


def with_default(value: Column, field: FieldSpec, is_list: bool) -> Column:
    fallback = default_value(field, is_list)
    return text.let(
        value,
        lambda v: F.when(text.is_empty(v, is_list), fallback).otherwise(v)
        if fallback is not None
        else F.when(~text.is_empty(v, is_list), v),
    )


def default_value(field: FieldSpec, is_list: bool) -> Column | None:
    """The field default as a literal of the field's type."""
    if field.default is None:
        return None
    if is_list:
        items = field.default if isinstance(field.default, (list, tuple)) else [field.default]
        return F.array(*[F.lit(str(i)) for i in items]).cast("array<string>")
    return F.lit(field.default).cast("string")


def field_needs(field: FieldSpec) -> NodeNeeds:
    if field.type:
        is_list_field(field)
        return EXTRACTORS[field.type].needs
    if field.selector:
        return compile_selector(field.selector).needs() | value_needs(field.attribute)
    if field.xpath:
        xp.check(field.xpath)
        if field.many and not xp.is_scalar(field.xpath) and not xp.selects_strings(field.xpath):
            css = xp.as_css(field.xpath)
            if css is None:
                return NodeNeeds(xhtml=True, numbered=True, text=True)
            return compile_selector(css).needs() | NodeNeeds(text=True)
        return NodeNeeds(xhtml=True)
    return NodeNeeds()


def _element_text(page: Page, node: Column) -> Column:
    """Text of an element as XPath has it. Scripts and styles inside it are left out."""
    own = node.tag.isin(sorted(OWN_TEXT_TAGS))
    return F.when(own, F.coalesce(node.raw, F.lit(""))).otherwise(node_content(page.texts, node))


def _xpath_value(page: Page, path: str, many: bool) -> Column:
    if xp.is_scalar(path):
        value = text.clean_whitespace(F.xpath_string(page.xhtml, F.lit(path)))
        return text.ordered_distinct(F.array(value)) if many else value
    if xp.selects_strings(path):
        values = F.xpath(page.xhtml, F.lit(path))
        return pick(text.ordered_distinct(F.transform(values, text.clean_whitespace)), many)
    if not many:
        return text.clean_whitespace(F.xpath_string(page.xhtml, F.lit(xp.first_filled(path))))
    css = xp.as_css(path)
    if css is not None:
        selector = compile_selector(css)
        found = F.filter(page.nodes, lambda n: selector.matches(n))
        return text.ordered_distinct(F.transform(found, lambda n: _element_text(page, n)))
    values = F.xpath(page.xhtml, F.lit(xp.numbered(path)))

    def value(item: Column) -> Column:
        place = F.substring(item, 2, 9).try_cast("int")
        node = F.get(page.nodes, place)
        return F.when(item.startswith(MARK), _element_text(page, node)).otherwise(text.clean_whitespace(item))

    return text.ordered_distinct(F.transform(values, value))


def field_value(page: Page, field: FieldSpec) -> Column:
    """A page field as one expression, default applied."""
    is_list = is_list_field(field)
    if field.type:
        value = EXTRACTORS[field.type].build(page)
    elif field.selector:
        values = css_values(page, compile_selector(field.selector), field.attribute)
        value = pick(values, field.many)
    elif field.xpath:
        value = _xpath_value(page, field.xpath, field.many)
    else:
        value = F.lit(None).cast("array<string>" if is_list else "string")
    return with_default(value, field, is_list)


def shred_for(
    pages: DataFrame,
    needs: NodeNeeds,
    keep: Sequence[str],
    raw: dict | None = None,
    html: str = "html",
) -> DataFrame:
    """Raw-HTML values plus, if any field needs nodes, the shredded arrays."""
    raw_columns = {f"__raw_{name}": build(F.col(html)) for name, build in (raw or {}).items()}
    source = pages.withColumns(raw_columns) if raw_columns else pages
    kept = [*keep, *raw_columns]
    if needs.needs_shred:
        return shred(source, needs, kept, html)
    return source.select(*kept).withColumn("shred_error", F.lit(None).cast("string"))


def extract_fields(
    pages: DataFrame,
    fields: Sequence[FieldSpec],
    keep: Sequence[str] = ("url",),
    url: str = "url",
    prefix: str = "",
    also: NodeNeeds = NodeNeeds(),
    extra: Callable[[Page], dict[str, Column]] | None = None,
) -> DataFrame:
    """``keep`` columns, one column per field (name behind ``prefix``), ``shred_error``.

    ``extra`` may add columns made from the same parse; ``also`` is what they need.
    """
    needs, raw = also, {}
    links = also | LINK_NEEDS == also  # enough is parsed to list the links
    for field in fields:
        needs |= field_needs(field)
        if field.type:
            raw.update(EXTRACTORS[field.type].raw or {})
            links = links or EXTRACTORS[field.type].links
    keep = list(dict.fromkeys([*keep, url]))
    shredded = shred_for(pages, needs, keep, raw)
    if links:
        shredded = shredded.withColumn("__links", page_links(url, "nodes", "texts"))
    page = Page(
        url=F.col(url),
        nodes=F.col("nodes"),
        texts=F.col("texts"),
        xhtml=F.col("xhtml"),
        raw={name: F.col(f"__raw_{name}") for name in raw},
        links=F.col("__links"),
    )
    added = extra(page) if extra else {}
    return shredded.select(
        *keep,
        *[field_value(page, field).alias(prefix + field.name) for field in fields],
        *[c.alias(name) for name, c in added.items()],
        "shred_error",
    )
