"""Shredding, selectors, XPath, extraction, shaping and page sources."""

import pytest
from pyspark.sql import functions as F

from sitelens.operators.css import compile_selector
from sitelens.operators.extract import Extractor, css_values, Page, extract_fields, register_extractor, shred_for
from sitelens.operators.merge import best_contact_email, merge_items, merge_pages
from sitelens.operators.quality import field_coverage, quality_summary
from sitelens.operators.records import cleanup_counters, output_columns, shape_records
from sitelens.operators.shred import NodeNeeds, shred
from sitelens.plans.spec import read_fields, read_shaping

URL = "https://www.a.com/dir/page"


def extract(spark, html, *fields, url=URL):
    df = spark.createDataFrame([(url, html)], "url string, html string")
    return extract_fields(df, read_fields(list(fields))).first().asDict()


def select(spark, html, selector, attribute=None):
    df = spark.createDataFrame([(URL, html)], "url string, html string")
    compiled = compile_selector(selector)
    every = NodeNeeds(everything=True, text=True, selectors=frozenset([selector]))
    shredded = shred(df, every, ["url"])
    page = Page(F.col("url"), F.col("nodes"), F.col("texts"), F.col("xhtml"), {}, F.lit(None))
    full = shredded.select(css_values(page, compiled, attribute).alias("v")).first()["v"]
    pruned = shred_for(df, compiled.needs() | NodeNeeds(text=True, attrs=frozenset([attribute or "id"])), ["url"])
    assert pruned.select(css_values(page, compiled, attribute).alias("v")).first()["v"] == full
    return full


HTML = """<!doctype html><title>T &amp; x</title><script>var a = "<p>no</p>";</script>
<ul id=menu class="nav  big"><li>one<li class=x>two <b>bold</b><ul><li>inner</ul><li>three</ul>
<p>first<p>second <i>it</i>al<div data-k="a b">block</div><!-- gone --><table><tr><td>c1<td>c2<tr><td>c3</table>
<a href="/x">A</a><a rel=next href="/n">N</a></b><select><option>o1<option selected>o2</select>"""


@pytest.mark.parametrize(
    "selector,want",
    [
        ("li", ["one", "two bold inner", "inner", "three"]),
        ("ul > li.x", ["two bold inner"]),
        ("ul ul li", ["inner"]),
        ("#menu > li", ["one", "two bold inner", "three"]),
        (".nav.big li b", ["bold"]),
        ("p", ["first", "second it al"]),
        ("td, option", ["c1", "c2", "c3", "o1", "o2"]),
        ("tr > td", ["c1", "c2", "c3"]),
        ("[data-k~=b]", ["block"]),
        ("[data-k^='a'], [data-k$=\"zz\"]", ["block"]),
        ("a[rel='next']", ["N"]),
        ("a[href*=x]", ["A"]),
        ("body > p", ["first", "second it al"]),
        ("head title", ["T & x"]),
        ("script", ['var a = "<p>no</p>";']),
        ("* > option", ["o1", "o2"]),
        ("ul + p", ["first"]),
        ("ul ~ p", ["first", "second it al"]),
        ("li:first-child", ["one", "inner"]),
        ("li:last-child", ["inner", "three"]),
        ("tr > td:nth-child(2)", ["c2"]),
        ("#menu > li:nth-child(odd)", ["one", "three"]),
        ("#menu > li:nth-child(-n+2)", ["one", "two bold inner"]),
        ("#menu > li:nth-last-child(2)", ["two bold inner"]),
        ("p:first-of-type, p:last-of-type", ["first", "second it al"]),
        ("p:nth-of-type(2)", ["second it al"]),
        ("td:only-child", ["c3"]),
        ("#menu > li:not(.x):not(:first-child)", ["three"]),
        ("a:not([rel], .q)", ["A"]),
        ("[data-k='A B' i]", ["block"]),
        ("[rel|=next]", ["N"]),
        ("li.x + li", ["three"]),
    ],
)
def test_selectors(spark, selector, want):
    assert select(spark, HTML, selector) == want


@pytest.mark.parametrize("selector", ["a:hover", "a:has()", "", "a >", "[x=", "a,,b", "a:not(b", ":nth-child(x)", ":is(> a)", ":has(> > a)"])
def test_unsupported_selectors_fail_when_the_plan_is_built(selector):
    with pytest.raises(ValueError):
        compile_selector(selector)


def test_attributes_and_depth(spark):
    assert select(spark, HTML, "a", "href") == ["/x", "/n"]
    deep = "<div>" * 5000 + "<b>end</b>"
    assert select(spark, deep, "b") == ["end"]


def test_bad_pages_do_not_stop_the_job(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "<![x<p>a"), (4, "<p>ok</p>")], "id int, html string")
    got = {r.id: r for r in shred(df, NodeNeeds(everything=True, text=True, xhtml=True), ["id"]).collect()}
    assert got[1].nodes == [] and got[2].nodes == [] and got[4].texts == ["ok"]
    assert got[4].xhtml == "<html><body><p>ok</p></body></html>"


def test_xpath(spark):
    got = extract(
        spark, "<main><h1>Mira  Q</h1><p>x<b>y</b></p><p>z</p><a href='tel:1'>c</a><a href='tel:2'/></main>",
        {"name": "h", "xpath": "normalize-space(//h1)"},
        {"name": "e", "xpath": "//main/h1"},
        {"name": "a", "xpath": "//a[starts-with(@href, 'tel:')]/@href", "many": True},
        {"name": "p", "xpath": "//main/p", "many": True},
        {"name": "none", "xpath": "//h9", "default": "d"},
    )
    assert got["h"] == "Mira Q" and got["e"] == "Mira Q" and got["a"] == ["tel:1", "tel:2"]
    assert got["p"] == ["xy", "z"] and got["none"] == "d"
    with pytest.raises(ValueError):
        extract(spark, "<p>", {"name": "p", "xpath": "//p[1]/following::b[", "many": True})


def test_builtin_extractors(spark):
    html = """<title> Acme - Home </title><meta property="og:description" content=" About  us ">
      <h1>Acme Tool Works</h1><h2></h2><h3>Acme Tool Works</h3>
      <a href="/contact/">Write</a><a href="//www.fedex.com/">F</a><a href="#x">x</a><a href="team">Our team</a>
      <a href="https://sub.a.com/contact">other</a><a href="tel:1">t</a>
      <div class="footer-address">12 Long Street, Town</div> sales@a.com (410) 555-0100"""
    names = ["page_title", "meta_description", "headings", "internal_links", "contact_links",
             "social_links", "address", "business_name", "email", "phone_numbers"]
    got = extract(spark, html, *[{"name": n, "type": n} for n in names])
    assert got["page_title"] == "Acme - Home" and got["meta_description"] == "About us"
    assert got["headings"] == ["Acme Tool Works"] and got["business_name"] == "Acme Tool Works"
    assert got["internal_links"] == ["https://www.a.com/contact", "https://www.a.com/dir/team"]
    assert got["contact_links"] == got["internal_links"]
    assert got["social_links"] == ["https://www.fedex.com/"]
    assert got["address"] == "12 Long Street, Town"
    assert got["email"] == ["sales@a.com"] and got["phone_numbers"] == ["(410) 555-0100"]
    site = extract(spark, '<meta property="og:site_name" content="Site"><title>x</title>', {"name": "b", "type": "business_name"})
    assert site["b"] == "Site"
    with pytest.raises(ValueError):
        extract(spark, "", {"name": "q", "type": "unknown"})


def test_a_registered_extractor(spark):
    register_extractor(
        "image_count",
        Extractor(lambda p: F.size(p.nodes).cast("string"), needs=NodeNeeds(tags=frozenset(["img"]))),
    )
    assert extract(spark, "<img><p><img>", {"name": "n", "type": "image_count"})["n"] == "2"


def test_shaping(spark):
    rows = spark.createDataFrame(
        [([" mailto:test@example.com ", "mailto:test@example.com", "", " "], [" tel:+1-555-111-2222 ", None], [" https://example.com "], [])],
        "emails array<string>, phones array<string>, website array<string>, notes array<string>",
    )
    options = read_shaping(
        {"cleanup_common_fields": True, "flatten_single_item_lists": True, "drop_empty_fields": True,
         "field_order": ["emails", "phones", "website"]}
    )
    got = shape_records(rows, options).first().asDict()
    assert got == {"emails": ["test@example.com"], "phones": ["+1-555-111-2222"], "website": ["https://example.com"], "notes": None}
    counts = {r["action"]: r["count"] for r in cleanup_counters(rows, options).collect()}
    assert counts == {
        "list_items_dropped": 3, "duplicate_list_items_removed": 1, "fields_flattened": 3, "fields_joined": 0,
        "mailto_prefix_removed": 2, "tel_prefix_removed": 1,
    }
    links = spark.createDataFrame(
        [("i", "s", ["x", "x ", "l"], "ignored")], "input_url string, source_url string, social_links array<string>, other string"
    )
    got = shape_records(
        links,
        read_shaping({"include_fields": ["input_url", "social_links", "source_url"], "exclude_fields": ["source_url"],
                      "join_fields": {"social_links": " | "}, "field_order": ["social_links"]}),
    )
    assert got.columns == ["social_links", "input_url"] and got.first()[0] == "x | l"
    assert output_columns(
        ["x"], [], shaping=read_shaping({"include_fields": ["input_url", "emails"], "field_order": ["emails", "input_url"]}),
        schema_columns=["input_url", "source_url", "emails", "phones"],
    ) == ["emails", "input_url"]


def test_merge(spark):
    rows = spark.createDataFrame(
        [("s", 1, ["h@e.com"], ["111"], "", None), ("s", 2, ["h@e.com", " t@e.com", ""], ["111", "222"], "B", None), ("r", 1, None, [], "C", [])],
        "seed string, rank int, emails array<string>, phones array<string>, title string, social array<string>",
    )
    specs = read_fields([{"name": "social", "many": True, "default": []}, {"name": "title", "default": "none"}])
    fields = {"emails": True, "phones": True, "title": False, "social": True}
    got = {r["seed"]: r for r in merge_pages(rows, "seed", "rank", fields, specs).collect()}
    assert got["s"]["emails"] == ["h@e.com", "t@e.com"] and got["s"]["phones"] == ["111", "222"]
    assert got["s"]["title"] == "B" and got["s"]["social"] == [] and got["r"]["emails"] is None
    items = merge_items(rows, ["seed"], "rank", ["emails"]).collect()
    assert {(r["item"], r["first_rank"]) for r in items} == {("h@e.com", 1), ("t@e.com", 2)}


def test_contact_email_choice(spark):
    rows = spark.createDataFrame(
        [(["a@x.org", "support@x.org", "Info@Other.org", "info@firm.com"], "https://www.firm.com/"), (["b@x.org", "c@x.org"], "https://x.net/")],
        "e array<string>, s string",
    )
    got = [r.b for r in rows.select(best_contact_email(F.col("e"), F.col("s")).alias("b")).collect()]
    assert got == ["info@firm.com", "c@x.org"]


def test_quality(spark):
    rows = spark.createDataFrame([("a@example.com", ""), (None, "555")], "email string, phone string")
    got = {r["field"]: r for r in field_coverage(rows, ["email", "phone", "website"]).collect()}
    assert got["email"]["filled"] == 1 and got["phone"]["fill_rate"] == 0.5 and got["website"]["empty"] == 2
    summary = quality_summary(rows, ["email", "phone", "website"]).first()
    assert summary["records_produced"] == 2 and summary["records_with_all_configured_fields_empty"] == 0
    none = field_coverage(rows.limit(0), ["email"]).first()
    assert none["fill_rate"] == 0.0


def test_field_expressions_stay_on_the_jvm(spark):
    """One Python hop for all fields, and only the needed columns are read."""
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    found = extract_fields(
        df, read_fields([{"name": "t", "type": "page_title"}, {"name": "l", "type": "internal_links"}]), ["url"]
    )
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "PythonUDF" not in plan and "BatchEval" not in plan
    assert "page_id" not in plan and "Exchange" not in plan
    raw_only = extract_fields(df, read_fields([{"name": "e", "type": "emails"}]), ["url"])
    assert "MapInArrow" not in raw_only._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "path,want",
    [
        ("//td[2]", ["c2"]),
        ("//tr/td[1]", ["c1", "c3"]),
        ("//li[contains(@class,'x')]/b", ["bold"]),
        ("//a[starts-with(@href, '/n')]", ["N"]),
        ("//option[last()]", ["o2"]),
        ("//ul/*[1]", ["one", "inner"]),
        ("//a[@rel='next']", ["N"]),
    ],
)
def test_texts_of_many_elements_by_xpath(spark, path, want):
    assert extract(spark, HTML, {"name": "f", "xpath": path, "many": True})["f"] == want


def test_broken_markup_keeps_what_was_read(spark):
    card = "<div class='c'><h2>A</h2></div>"
    for tail in ("<![x<p>a", "<![weird[ a ]]><div class='c'><h2>B</h2></div>", "<!x", "</", "<a href='", "<![if !IE]>"):
        assert select(spark, card + tail, ".c h2")[0] == "A", tail
    assert select(spark, card + "<![weird[ a ]]><div class='c'><h2>B</h2></div>", ".c h2") == ["A", "B"]


def test_deep_nesting_keeps_parents(spark):
    deep = "<div>" * 600 + "<p class=x>in</p>" + "</div>" * 600 + "<p class=x>out</p>"
    assert select(spark, deep, "div > .x") == ["in"]
    assert select(spark, deep, "body > .x") == ["out"]
    assert select(spark, deep, "body > div div .x") == ["in"]
