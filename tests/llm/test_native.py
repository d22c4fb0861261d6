"""URL filters and license scans against plain Python, and their plans."""

import random
import re

import pytest

from sitelens.llm import licenses, queries, url_rules

PAGES = "page_id long, url string, host string, rule string, token string"


def plain(url, rules):
    at = (url or "").find("://")
    if at < 0:
        return "", "", None, "allow"
    rest = re.split(r"[?#]", url[at + 3 :], maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    host = "".join(c.lower() if c.isascii() else c for c in host)
    path = slash + path
    fit = [r for r in rules
           if ("." + host).endswith("." + r[0].partition("/")[0])
           and path.startswith("/" + r[0].partition("/")[2])]
    best = min(fit, key=lambda r: (-len(r[0]), r[1] != "block", r[0]), default=None)
    if best:
        return host, path, *best
    spam = any(re.search(p, host + path) for _, p, _ in url_rules.SPAM)
    return host, path, None, "block" if spam else "allow"


ODD = [
    None, "", "no scheme", "http://", "http://a.net", "http://a.net/", "HTTP://WWW.Example.NET/en/x",
    "http://example.net/en", "http://example.net/EN/", "http://notexample.net/en/1", "x://org/fr/",
    "http://a.org/fr/?q=://b.net/", "http://a.org#/fr/", "http://a.org?x/fr/", "http://é.É.net/\u00e9",
    "http://u@example.com/de/", "http://example.com:80/de/1", "http://cheap-pills.a.com/", "a://b://c.net/d",
    "http://x.net/" + "y" * 100_000, "http://a\nb.net/c", "http://sub.example.com/de/free-bets/",
]


def test_urls_against_plain_version(spark):
    rng = random.Random(1)
    hosts = ["example.net", "www.example.net", "a.example.com", "x.org", "y.co", "net", "ads-track.y.co"]
    urls = ODD + [
        f"http://{rng.choice(hosts)}/{rng.choice(['en', 'de', 'fr', ''])}{rng.choice(['', '/', '/1', '?q'])}"
        for _ in range(200)
    ]
    rows = [(i, u, "h", "r", "t") for i, u in enumerate(urls)] + [(3, "http://a.net/", "h", "r", "t")] * 3
    rows += [(None, "http://a.net/", None, None, None)]
    more = [*queries.RULES, ("co/", "block"), ("co/en", "allow"), ("y.co/", "allow")]
    found = url_rules.judge(spark.createDataFrame(rows, PAGES), more)
    got = sorted(((r.page_id or 0), r.host, r.path, r.rule or "", r.verdict) for r in found.collect())
    want = sorted(((r[0] or 0), *(x or "" for x in plain(r[1], more))) for r in rows)
    assert got == want


def test_urls_empty_table_and_no_rules(spark):
    assert url_rules.judge(spark.createDataFrame([], PAGES), queries.RULES).count() == 0
    pages = spark.createDataFrame([(1, "http://a.net/", "", "", "")], PAGES)
    assert url_rules.judge(pages, [], []).first().verdict == "allow"


def test_rules_with_upper_case_hosts_fit(spark):
    pages = spark.createDataFrame([(1, "http://www.Example.net/En/x"), (2, "http://example.net/en/x")], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_rules.judge(pages, [("EXAMPLE.net/En/", "block")]).collect()}
    assert got == {1: ("EXAMPLE.net/En/", "block"), 2: (None, "allow")}


def test_native_plans(spark, sf_dir):
    for name in ("op5_url_rules", "op7_licenses"):
        plan = queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)
        assert not re.search("CartesianProduct|BroadcastNestedLoop", plan)
    assert "html" not in queries.QUERIES["op5_url_rules"](
        spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def triples(text):
    words = re.findall(r"[a-z0-9]+", (text or "").lower())
    return [tuple(words[i : i + 3]) for i in range(len(words) - 2)]


def test_licenses_against_every_window(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    mit = {t[0]: t[1] for t in licenses.TEMPLATES}["mit-notice"]
    cut = mit.split()
    cut[20] = "changed"
    rows += [
        (10_001, None), (10_002, ""), (10_003, "two words"), (10_004, "w " * 60_000 + mit),
        (10_005, " ".join(cut)), (10_006, mit.upper()), (10_006, mit.upper()), (10_007, "x y z " * 90 + mit[:60]),
    ]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, license string, kind int")
    got = {(r.doc_id, r.license): r.containment for r in licenses.scan(docs).collect()}
    want = {}
    for doc_id, text in rows:
        have = set(triples(text))
        for name, wording, *least in licenses.TEMPLATES:
            own = set(triples(wording))
            if len(own & have) >= (*least, 0.8)[0] * len(own):  # contiguous here: notices stand whole
                want[doc_id, name] = len(own & have) / len(own)
    assert got == want
    assert (10_005, "mit-notice") in got and (10_004, "mit-notice") in got
    assert licenses.scan(docs.limit(0)).count() == 0


def found(spark, texts, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {i: {} for i in range(len(texts))}
    for r in licenses.scan(docs, **options).collect():
        out[r.doc_id][r.license] = (r.containment, r.first_word)
    return out


def test_common_licenses_are_found(spark):
    texts = {
        "// SPDX-License-Identifier: Apache-2.0": "tag:apache-2.0",
        "/* SPDX-License-Identifier: GPL-2.0-only */": "tag:gpl-2.0",
        "This file is under the GNU Lesser General Public License version 2.1, see COPYING.": "name:lgpl-2.1",
        "Subject to the Mozilla Public License 2.0": "name:mpl-2.0:short",
        "This is free and unencumbered software released into the public domain.": "unlicense",
        "Licensed under CC BY-SA 4.0.": "short:cc-by-sa-4.0",
        "(BSD 3-Clause License)": "name:bsd-3-clause",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License": "cc-by-sa-4.0",
        "either the GNU General Public License version 2 or": "name:gpl-2.0",
        "no license here, but a general public that works": None,
    }
    got = found(spark, texts)
    for (text, license), have in zip(texts.items(), got.values(), strict=True):
        assert have[license][0] == 1.0 if license else not have, text
        # Only what is worded like it, and the name inside it, may stand beside it.
        assert len([n for n, (share, _) in have.items() if share == 1.0 and not n.startswith("name:")]) <= 1, text
    # Siblings that differ in a version or a clause keep apart.
    gpl = {t[0]: t[1] for t in licenses.TEMPLATES}
    for name in ("lgpl-2.1-notice", "lgpl-3.0-notice", "agpl-3.0-notice", "gpl-2.0-notice"):
        have = found(spark, [gpl[name]])[0]
        assert have[name][0] == 1.0
        assert [n for n, (share, _) in have.items() if share == 1.0 and n.endswith("-notice")] == [name]


def test_first_word_is_where_the_notice_begins(spark):
    mit = {t[0]: t[1] for t in licenses.TEMPLATES}["mit-notice"]
    own = mit.split()
    changed = " ".join(["Allowance", *own[1:]])  # its first shingle is another one
    filler = " ".join(f"w{i}" for i in range(100))
    got = found(spark, [f"{filler} {mit}", f"{filler} {changed}", f"{filler} {filler} {mit} {mit}"])
    assert [got[i]["mit-notice"][1] for i in range(3)] == [100, 101, 200]


def test_templates_have_bounds(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    with pytest.raises(ValueError, match="more than"):
        licenses.scan(docs, [("long", "w " * 20_001)])
    with pytest.raises(ValueError, match="fewer than"):
        licenses.scan(docs, [("short", "two words")])
