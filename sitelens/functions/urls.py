"""URL resolution and normalization as Column expressions.

``java.net.URI`` based functions reject spaces and other characters that real
links contain, so URLs are cut with one RFC 3986 pattern into an array
``[scheme, authority, path, params, query, fragment]`` and rebuilt from it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitelens.functions.text import cached_by_name, let, strip

SEP = "\x01"
_SPLIT = (
    r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?"  # scheme
    r"(?://([^/?#]*))?"  # authority
    r"((?:[^?#]*/)?[^/?#;]*)"  # path
    r"(?:;([^/?#]*))?"  # parameters of the last segment
    r"(?:\?([^#]*))?"  # query
    r"(?:#(.*))?$"  # fragment
)
_HOST = (
    r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#]*@)?\[?"
    r"((?<=\[)[^\]/?#]*|[^:/?#\[\]]*)"
)
_DOMAIN = (
    r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#]*@)?\[?(?:(?i)www\.)?"
    r"((?<=\[)[^\]/?#]*|[^:/?#\[\]]*)"
)
_SIMPLE_PATH = r"^/(?![/.])(?:[^\s\p{C}?#;/]+(?:/(?![/.])|(?=$)))*$"

# An absolute URL or bare host that normalization only has to trim: lower-case
# host, no port, plain path, encoded-looking query. Group 1 ends before the final
# slash, group 2 is the query.
_SIMPLE_URL = (
    r"^((?:https?://)?[a-z0-9-]+(?:\.[a-z0-9-]+)*(?:/[^\s\p{C}?#;/]+)*)/?"
    r"(\?[A-Za-z0-9_.~-]+=[A-Za-z0-9_.~-]*(?:&[A-Za-z0-9_.~-]+=[A-Za-z0-9_.~-]*)*)?(?:#\P{C}*)?$"
)

# Link prefixes that never lead to a page.
SKIPPED_PREFIXES = r"(?i)^(#|mailto:|tel:|javascript:|data:)"
# Suffix parts that make a registered name three labels long.
SECOND_LEVEL_LABELS = ["ac", "co", "com", "edu", "gov", "net", "org"]
COUNTRY_LABELS = ["au", "jp", "nz", "uk"]


def _tidy(c: Column) -> Column:
    """Drop the characters URL parsers ignore: tabs, newlines, leading controls."""
    return F.regexp_replace(c, r"^[\x00-\x20]+|[\t\r\n]", "")


def _parts(c: Column) -> Column:
    marked = F.regexp_replace(c, _SPLIT, SEP.join(f"${i}" for i in range(1, 7)))
    return F.split(marked, SEP, 6)


def _bad_authority(authority: Column) -> Column:
    """Unbalanced or non-address brackets make the whole URL invalid."""
    return authority.rlike(r"[\[\]]") & ~authority.rlike(
        r"^(?:[^\[\]]*@)?\[(?:[0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*|[vV][0-9A-Fa-f]+\.[^\[\]]+)\](?::[^\[\]]*)?$"
    )


def _dot_segments(segments: Column) -> Column:
    """Apply "." and ".." with a stack fold."""
    folded = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, seg: F.when(
            seg == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        )
        .when(seg == ".", acc)
        .otherwise(F.array_append(acc, seg)),
    )
    last = F.element_at(segments, -1)
    return F.when(last.isin(".", ".."), F.array_append(folded, F.lit(""))).otherwise(folded)


def _optional(prefix: str, part: Column) -> Column:
    return F.when(part == "", F.lit("")).otherwise(F.concat(F.lit(prefix), part))


def _join_parts(base: Column, ref: Column) -> Column:
    """Rebuild a reference against an absolute http(s) base, both as part arrays."""

    def resolved_path(path: Column) -> Column:
        base_segments = F.split(base[2], "/")
        kept = F.when(
            F.element_at(base_segments, -1) != "",
            F.slice(base_segments, F.lit(1), F.greatest(F.size(base_segments) - 1, F.lit(0))),
        ).otherwise(base_segments)
        merged = F.concat(kept, F.split(path, "/"))
        relative = let(
            merged,
            lambda m: F.filter(m, lambda s, i: (i == 0) | (i == F.size(m) - 1) | (s != "")),
        )
        segments = F.when(path.startswith("/"), F.split(path, "/")).otherwise(relative)
        joined = let(segments, lambda s: F.array_join(_dot_segments(s), "/"))
        return let(
            joined,
            lambda j: F.when(j == "", F.lit("/"))
            .when(j.startswith("/"), j)
            .otherwise(F.concat(F.lit("/"), j)),
        )

    same_page = (ref[2] == "") & (ref[3] == "")
    own_site = ref[1] != ""
    authority = F.when(own_site, ref[1]).otherwise(base[1])
    path = (
        F.when(
            own_site,
            F.when((ref[2] == "") | ref[2].startswith("/"), ref[2]).otherwise(
                F.concat(F.lit("/"), ref[2])
            ),
        )
        .when(same_page, base[2])
        .otherwise(resolved_path(ref[2]))
    )
    params = F.when(~own_site & same_page, base[3]).otherwise(ref[3])
    query = F.when(~own_site & same_page & (ref[4] == ""), base[4]).otherwise(ref[4])
    return F.concat(
        F.lower(base[0]),
        F.lit("://"),
        authority,
        path,
        _optional(";", params),
        _optional("?", query),
        _optional("#", ref[5]),
    )


def url_origin(url: Column) -> Column:
    """``scheme://authority`` of an absolute URL."""
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)


def urljoin(base: Column, ref: Column, origin: Column | None = None) -> Column:
    """Resolve ``ref`` against the absolute http(s) URL ``base``.

    A plain root-relative path is glued to ``origin`` directly; ``origin`` can be
    passed in when many links share one base.
    """
    origin = url_origin(base) if origin is None else origin
    general = let(
        F.struct(_parts(base).alias("b"), _parts(_tidy(ref)).alias("r")),
        lambda p: F.when(_bad_authority(p.r[1]), F.lit(None).cast("string"))
        .when((p.r[0] != "") & (F.lower(p.r[0]) != F.lower(p.b[0])), ref)
        .otherwise(_join_parts(p.b, p.r)),
    )
    return (
        F.when(ref.rlike(_SIMPLE_PATH), F.concat(origin, ref))
        .when(ref == "", base)
        .otherwise(general)
    )


def _encode_query(query: Column) -> Column:
    """Decode and re-encode every pair the way form encoding does."""

    def decode(x: Column) -> Column:
        # A "%" that starts no escape stands for itself.
        return F.url_decode(F.regexp_replace(x, "%(?![0-9A-Fa-f]{2})", "%25"))

    def encode(x: Column) -> Column:
        # Java's form encoding differs from RFC 3986 in these two characters.
        encoded = F.url_encode(decode(x))
        return F.replace(F.replace(encoded, F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))

    def pair(x: Column) -> Column:
        key = F.substring_index(x, "=", 1)
        value = F.when(F.contains(x, F.lit("=")), F.substr(x, F.instr(x, "=") + 1)).otherwise("")
        return F.concat(encode(key), F.lit("="), encode(value))

    pairs = F.filter(F.split(query, "&"), lambda x: x != "")
    return F.array_join(F.transform(pairs, pair), "&")


def _normalize_absolute(value: Column) -> Column:
    """Normalize a stripped, non-empty value that is already resolved."""
    with_scheme = F.when(value.rlike("^https?://"), value).otherwise(
        F.concat(F.lit("https://"), value)
    )

    def rebuild(p: Column) -> Column:
        authority = F.lower(p[1])
        port = F.when(p[0] == "http", F.lit(":80")).otherwise(F.lit(":443"))
        authority = F.when(
            authority.endswith(port) & (F.instr(authority, ":") == F.length(authority) - F.length(port) + 1),
            F.substr(authority, F.lit(1), F.length(authority) - F.length(port)),
        ).otherwise(authority)
        path = F.when(p[2].isin("", "/"), F.lit("/")).otherwise(F.rtrim(p[2], F.lit("/")))
        query = F.when(p[4] == "", F.lit("")).otherwise(_encode_query(p[4]))
        return F.concat(
            p[0], F.lit("://"), authority, path, _optional(";", p[3]), _optional("?", query)
        )

    return let(
        _parts(_tidy(with_scheme)),
        lambda p: F.when(_bad_authority(p[1]), F.lit(None).cast("string")).otherwise(rebuild(p)),
    )


def _trim_simple(v: Column) -> Column:
    kept = F.regexp_extract(v, _SIMPLE_URL, 1)
    return F.concat(
        F.when(v.rlike("^https?://"), F.lit("")).otherwise("https://"),
        kept,
        F.when(kept.rlike("^(?:https?://)?[^/]+$"), F.lit("/")).otherwise(""),
        F.regexp_extract(v, _SIMPLE_URL, 2),
    )


@cached_by_name
def normalize_url(value: Column, base: Column | None = None, origin: Column | None = None) -> Column:
    """Canonical form of a URL; null for blank or invalid input.

    With ``base`` (an already normalized URL) the value is resolved first.
    """
    stripped = strip(value)
    if base is None:
        return let(
            stripped,
            lambda v: F.when(v == "", F.lit(None).cast("string"))
            .when(v.rlike(_SIMPLE_URL), _trim_simple(v))
            .otherwise(_normalize_absolute(v)),
        )
    origin = url_origin(base) if origin is None else origin
    return let(
        stripped,
        lambda v: F.when(v.isNull() | (v == ""), F.lit(None).cast("string"))
        .when(
            v.rlike(_SIMPLE_PATH),
            F.when(v == "/", F.concat(origin, v)).otherwise(
                F.concat(origin, F.rtrim(v, F.lit("/")))
            ),
        )
        .otherwise(_normalize_absolute(urljoin(base, v, origin))),
    )


def is_http_url(url: Column) -> Column:
    return url.rlike("(?i)^https?:")


def should_skip_url(href: Column) -> Column:
    return (href == "") | href.rlike(SKIPPED_PREFIXES)


def hostname(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _HOST, 1))


@cached_by_name
def canonical_domain(url: Column) -> Column:
    """Host without one leading ``www.``."""
    return F.lower(F.regexp_extract(url, _DOMAIN, 1))


def same_domain(a: Column, b: Column) -> Column:
    return canonical_domain(a) == canonical_domain(b)


def root_domain(host: Column) -> Column:
    """The last two labels, or three below well-known country suffixes."""
    return let(
        F.filter(F.split(host, r"\."), lambda x: x != ""),
        lambda labels: F.array_join(
            F.when(F.size(labels) <= 2, labels)
            .when(
                F.element_at(labels, -1).isin(COUNTRY_LABELS)
                & F.element_at(labels, -2).isin(SECOND_LEVEL_LABELS),
                F.slice(labels, -3, 3),
            )
            .otherwise(F.slice(labels, -2, 2)),
            ".",
        ),
    )


@cached_by_name
def normalize_domain(value: Column) -> Column:
    """Registered domain of a website value; "" when there is none."""
    return F.coalesce(root_domain(canonical_domain(normalize_url(value))), F.lit(""))


@cached_by_name
def normalize_url_value(value: Column) -> Column:
    """Normalized URL, or the lower-cased text where it is not a URL."""
    return F.when(value == "", F.lit("")).otherwise(
        F.coalesce(normalize_url(value), F.lower(strip(value)))
    )


@cached_by_name
def page_label(url: Column, number: Column) -> Column:
    """File label of a stored page: number, last path parts, query pairs."""

    def form_decode(x: Column) -> Column:
        return F.url_decode(F.regexp_replace(x, "%(?![0-9A-Fa-f]{2})", "%25"))

    def build(p: Column) -> Column:
        segments = F.filter(F.split(p[2], "/"), lambda s: s != "")
        tail = F.when(F.size(segments) > 2, F.slice(segments, -2, 2)).otherwise(segments)
        label = F.when(F.size(segments) == 0, F.lit("home")).otherwise(F.array_join(tail, "_"))
        pairs = F.filter(F.split(p[4], "&"), lambda x: x.rlike("=."))
        keyed = F.transform(
            pairs,
            lambda x, i: F.struct(
                form_decode(F.substring_index(x, "=", 1)).alias("k"),
                i.alias("i"),
                form_decode(F.substr(x, F.instr(x, "=") + 1)).alias("v"),
            ),
        )
        # Values of one key follow each other, so a key is printed at its first pair.
        suffix = let(
            F.array_sort(keyed),
            lambda ks: F.array_join(
                F.transform(
                    ks,
                    lambda e, i: F.when(
                        (i > 0) & (F.get(ks, i - 1).k == e.k), e.v
                    ).otherwise(F.concat(e.k, F.lit("_"), e.v)),
                ),
                "_",
            ),
        )
        text = F.when(F.size(pairs) == 0, label).otherwise(F.concat(label, F.lit("_"), suffix))
        slug = F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), F.lit("_"))
        return F.concat(
            F.lit("page_"),
            F.lpad(number.cast("string"), F.greatest(F.length(number.cast("string")), F.lit(3)), F.lit("0")),
            F.lit("_"),
            F.when(slug == "", F.lit("run")).otherwise(slug),
        )

    return let(_parts(url), build)


# Address blocks that are not globally routable, as (network, bits).
PRIVATE_IPV4 = [
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8),
    ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24),
    ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24),
    ("203.0.113.0", 24), ("240.0.0.0", 4),
]
ROUTABLE_IPV4_EXCEPTIONS = ["192.0.0.9", "192.0.0.10"]
PRIVATE_IPV6 = r"^(::1?$|::ffff:|f[cd][0-9a-f]{2}:|fe[89ab][0-9a-f]:|2001:0?db8:|64:ff9b:1:|100::)"
LOCAL_HOSTS = ["localhost", "127.0.0.1", "0.0.0.0"]


def _ipv4_number(text: str) -> int:
    number = 0
    for octet in text.split("."):
        number = number * 256 + int(octet)
    return number


@cached_by_name
def is_public_target(value: Column) -> Column:
    """Whether a submitted URL may be visited; false for blank or invalid input."""
    octet = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    scheme = F.lower(F.regexp_extract(_tidy(strip(value)), r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))

    def host_ok(host: Column) -> Column:
        octets = F.split(host, r"\.")
        number = F.aggregate(
            F.transform(octets, lambda o: F.try_to_number(o, F.lit("999")).cast("bigint")),
            F.lit(0).cast("bigint"),
            lambda acc, o: acc * 256 + o,
        )
        inside = F.lit(False)
        for network, bits in PRIVATE_IPV4:
            low = _ipv4_number(network)
            inside = inside | number.between(low, low + 2 ** (32 - bits) - 1)
        return (
            F.when(host.isin(LOCAL_HOSTS), F.lit(False))
            .when(host.isin(ROUTABLE_IPV4_EXCEPTIONS), F.lit(True))
            .when(host.rlike(rf"^{octet}(?:\.{octet}){{3}}$"), ~inside)
            .when(host.contains(":"), ~host.rlike(PRIVATE_IPV6))
            .otherwise(F.lit(True))
        )

    verdict = let(normalize_url(value), lambda u: F.when(u.isNotNull(), host_ok(hostname(u))))
    return F.when(scheme.isin("", "http", "https"), F.coalesce(verdict, F.lit(False))).otherwise(
        F.lit(False)
    )
