"""URL functions against the standard library on fixed and random input."""

from urllib.parse import parse_qsl, urlencode, urljoin as std_join, urlsplit

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sitelens.functions import urls as U

BASE = "https://Www.Example.com/a/b/c.html?q=1"


def run(spark, rows, schema, **columns):
    df = spark.createDataFrame(rows, schema)
    return [r.asDict() for r in df.select(*[c.alias(n) for n, c in columns.items()]).collect()]


def expected_query(url):
    query = urlsplit(url).query
    return urlencode(parse_qsl(query, keep_blank_values=True))


@pytest.mark.parametrize(
    "value,base,want",
    [
        ("Example.COM", None, "https://example.com/"),
        ("https://A.com:443/x//?b=1&a#f", None, "https://a.com/x?b=1&a="),
        ("http://a.com:443/", None, "http://a.com:443/"),
        ("http://a.com:80", None, "http://a.com/"),
        ("../d", "https://a.com/b/c", "https://a.com/d"),
        ("", None, None),
        ("  　", None, None),
        ("HTTP://x", None, "https://http://x"),
        ("ftp://h", None, "https://ftp://h"),
        ("https://a.com//", None, "https://a.com"),
        ("https://a.com/x/;p", None, "https://a.com/x;p"),
        ("https://a.com/?a&b=1%zz&c=x y~*&&d=%C3%A9&e=", None,
         "https://a.com/?a=&b=1%25zz&c=x+y~%2A&d=%C3%A9&e="),
        ("https://a.com/?b=1%zz%20a", None, "https://a.com/?b=1%25zz+a"),
        ("https://[::1/", None, None),
        ("https://[::1]:443/", None, "https://[::1]:443/"),
        ("//cdn.x.org/y/", "https://a.com/b", "https://cdn.x.org/y"),
        ("?p=2", "https://a.com/b?x=1", "https://a.com/b?p=2"),
        ("/a/./b/../c", "https://a.com/b", "https://a.com/a/c"),
        ("g;x=1/../y", "https://a.com/b/c", "https://a.com/b/y"),
        ("/", "https://a.com/b", "https://a.com/"),
        ("/The,/", "https://a.com/b", "https://a.com/The,"),
    ],
)
def test_normalize_url(spark, value, base, want):
    cols = U.normalize_url(F.col("v"), F.col("b") if base else None)
    got = run(spark, [(value, base)], "v string, b string", u=cols)[0]["u"]
    assert got == want


segment = st.sampled_from(["a", "b.c", "..", ".", "", "d e", "x;y", "é", "*~"])
reference = st.builds(
    lambda lead, parts, query, frag: lead + "/".join(parts) + query + frag,
    st.sampled_from(["", "/", "//h.org/", "http:", "https://z.net/", "mailto:", "./", "../"]),
    st.lists(segment, max_size=5),
    st.sampled_from(["", "?", "?a=1&b", "?x=%41%zz+y&&=1"]),
    st.sampled_from(["", "#", "#top/x?y"]),
)


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(reference, min_size=80, max_size=120))
def test_urljoin_matches_the_standard_library(spark, refs):
    base = "https://www.example.com/a/b/c.html"
    df = spark.createDataFrame([(r,) for r in refs], "r string")
    got = [r.u for r in df.select(U.urljoin(F.lit(base), F.col("r")).alias("u")).collect()]
    for ref, mine in zip(refs, got):
        # An empty "?" or "#" carries no content and is dropped on both sides.
        assert mine.rstrip("?#") == std_join(base, ref).rstrip("?#"), ref


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text("ab=&%+~*é 4125zG;", max_size=14), min_size=80, max_size=120))
def test_query_encoding_matches_the_standard_library(spark, queries):
    df = spark.createDataFrame([(f"https://a.com/x?{q}y",) for q in queries], "u string")
    got = [r.u for r in df.select(U.normalize_url(F.col("u")).alias("u")).collect()]
    for query, mine in zip(queries, got):
        want = expected_query(f"https://a.com/x?{query}y")
        assert mine == "https://a.com/x" + (f"?{want}" if want else ""), query


plain = st.builds(
    lambda scheme, host, path, query, frag: scheme + host + path + query + frag,
    st.sampled_from(["", "http://", "https://", "HTTP://", "http:", "ftp://"]),
    st.sampled_from(["a.com", "www.b-c.co.uk", "A.com", "a.com:443", "x", "a..b", "u@h.org"]),
    st.sampled_from(["", "/", "/x", "/x/", "/x//", "/a/b.c/../d", "/é,", "/a;p", "/%41"]),
    st.sampled_from(["", "?", "?a=1", "?a=1&b=", "?a", "?a=%41", "?a=b~c&&d=1", "?a=x y"]),
    st.sampled_from(["", "#", "#top", "#a/b?c"]),
)


def by_the_book(value):
    value = value.strip()
    if not value.startswith(("http://", "https://")):
        value = "https://" + value
    parts = urlsplit(value)
    path, _, params = parts.path.partition(";") if ";" in parts.path.rsplit("/", 1)[-1] else (parts.path, "", "")
    netloc = parts.netloc.lower()
    default = ":80" if parts.scheme == "http" else ":443"
    if netloc.count(":") == 1 and netloc.endswith(default):
        netloc = netloc[: -len(default)]
    path = "/" if path in ("", "/") else path.rstrip("/")
    query = expected_query(value)
    return f"{parts.scheme}://{netloc}{path}" + (f";{params}" if params else "") + (f"?{query}" if query else "")


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(plain, min_size=150, max_size=200))
def test_normalization_rules_on_random_urls(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "u string")
    got = [r.u for r in df.select(U.normalize_url("u").alias("u")).collect()]
    for value, mine in zip(values, got):
        assert mine == by_the_book(value), value


def test_domains_and_labels(spark):
    rows = [
        ("https://www.a.com/", "a.com", "a.com"),
        ("https://m.a.com:8080/x", "m.a.com", "a.com"),
        ("https://u:p@x.y.co.uk/", "x.y.co.uk", "y.co.uk"),
        ("https://a.b.co.in/", "a.b.co.in", "co.in"),
        ("https://[2001:db8::1]:80/", "2001:db8::1", "2001:db8::1"),
    ]
    for row in run(
        spark, rows, "u string, d string, r string",
        got=U.canonical_domain(F.col("u")), want=F.col("d"),
        root=U.root_domain(U.canonical_domain(F.col("u"))), want_root=F.col("r"),
    ):
        assert row["got"] == row["want"] and row["root"] == row["want_root"]
    pairs = [("https://www.a.com/", "http://a.com/x", True), ("https://www.a.com/", "https://m.a.com/", False)]
    for row in run(
        spark, pairs, "a string, b string, same boolean",
        got=U.same_domain(F.col("a"), F.col("b")), want=F.col("same"),
    ):
        assert row["got"] == row["want"]
    labels = [
        ("https://example.com/", 1, "page_001_home"),
        ("https://example.com/contact", 2, "page_002_contact"),
        ("https://example.com/contact?tab=team", 3, "page_003_contact_tab_team"),
        ("https://example.com/a/b/c?z=1&b=2&z=3", 1234, "page_1234_b_c_b_2_z_1_3"),
    ]
    for row in run(
        spark, labels, "u string, n int, want string",
        got=U.page_label(F.col("u"), F.col("n")), want=F.col("want"),
    ):
        assert row["got"] == row["want"]


def test_public_targets(spark):
    import ipaddress

    addresses = ["10.1.2.3", "8.8.8.8", "100.64.0.1", "172.31.0.1", "172.32.0.1", "192.0.0.9",
                 "192.0.0.8", "198.19.0.1", "203.0.113.9", "224.0.0.1", "240.0.0.1", "127.9.9.9"]
    rows = [(f"http://{a}/x", ipaddress.ip_address(a).is_global) for a in addresses]
    rows += [(u, False) for u in ("http://localhost", "http://127.0.0.1", "http://192.168.1.10",
                                  "file:///etc/passwd", "ftp://example.com", "", "http://[::1]/",
                                  "http://[fe80::1]/", "http://[2001:db8::1]/")]
    rows += [("example.com", True), ("https://01.2.3.4/", True), ("http://[2606:4700::1]/", True)]
    for row in run(spark, rows, "u string, want boolean",
                   u=F.col("u"), got=U.is_public_target(F.col("u")), want=F.col("want")):
        assert row["got"] == row["want"], row["u"]
