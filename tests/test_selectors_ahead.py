"""CSS that looks ahead and XPath for many elements, on made trees against plain walks."""

import random
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from sitelens.operators import xpath as xp
from sitelens.operators.css import compile_selector
from sitelens.operators.extract import extract_fields
from sitelens.operators.matching import PageTree, looks_ahead, parse
from sitelens.operators.shred import NodeNeeds, shred
from sitelens.plans.spec import read_fields

TAGS = ["div", "section", "b", "i", "em"]


def made_page(draw, size):
    """A well-formed body of nested elements with numbered texts."""
    out, open_tags, number = [], [], 0
    for _ in range(size):
        if open_tags and draw.random() < 0.45:
            out.append(f"</{open_tags.pop()}>")
            continue
        tag = draw.choice(TAGS)
        number += 1
        attrs = "".join(f' {a}="{draw.choice("xyz")}"' for a in ("class", "title", "lang") if draw.random() < 0.35)
        out.append(f"<{tag}{attrs}>" + (f"t{number}" if draw.random() < 0.6 else ""))
        open_tags.append(tag)
    return "<html><body>" + "".join(out + [f"</{t}>" for t in reversed(open_tags)]) + "</body></html>"


class Walk:
    """Plain questions about an ElementTree."""

    def __init__(self, page):
        self.root = ElementTree.fromstring(page)
        self.parent = {c: p for p in self.root.iter() for c in p}
        self.all = list(self.root.iter())

    def siblings(self, e):
        return list(self.parent[e]) if e in self.parent else [e]

    def before(self, e):
        return self.siblings(e)[: self.siblings(e).index(e)]

    def after(self, e):
        return self.siblings(e)[self.siblings(e).index(e) + 1 :]

    def above(self, e):
        while e in self.parent:
            e = self.parent[e]
            yield e

    def below(self, e):
        return list(e.iter())[1:]

    def is_last(self, e):
        return not self.after(e)

    def is_empty(self, e):
        return not len(e) and not (e.text or "").strip()

    def text(self, e):
        return " ".join("".join(e.itertext()).split())

    def own_texts(self, e):
        return [t for t in [e.text, *[c.tail for c in e]] if t]


def tag(name):
    return lambda e: e.tag == name


def cls(e, value):
    return value in (e.get("class") or "").split()


CSS = {
    "div:has(b)": lambda w, e: e.tag == "div" and any(x.tag == "b" for x in w.below(e)),
    "div:has(> b, > i)": lambda w, e: e.tag == "div" and any(x.tag in "bi" for x in e),
    "b:has(+ i)": lambda w, e: e.tag == "b" and w.after(e)[:1] and w.after(e)[0].tag == "i",
    "b:has(~ i.x)": lambda w, e: e.tag == "b" and any(x.tag == "i" and cls(x, "x") for x in w.after(e)),
    "section:has(div > b i)": lambda w, e: e.tag == "section" and any(
        i.tag == "i" and any(b.tag == "b" and w.parent.get(b) is not None and w.parent[b].tag == "div" and e in w.above(w.parent[b])
                             for b in w.above(i)) for i in w.below(e)),
    "div:not(:has(b))": lambda w, e: e.tag == "div" and not any(x.tag == "b" for x in w.below(e)),
    "div:last-child b": lambda w, e: e.tag == "b" and any(a.tag == "div" and w.is_last(a) for a in w.above(e)),
    "div:nth-last-child(2) > *": lambda w, e: e in w.parent and w.parent[e].tag == "div" and len(w.after(w.parent[e])) == 1,
    "b:only-of-type + i": lambda w, e: e.tag == "i" and bool(w.before(e)) and w.before(e)[-1].tag == "b"
    and sum(x.tag == "b" for x in w.siblings(e)) == 1,
    ":is(b, i.x, div > em)": lambda w, e: e.tag == "b" or (e.tag == "i" and cls(e, "x"))
    or (e.tag == "em" and w.parent[e].tag == "div"),
    ":where(div, section) :is(b, i):empty": lambda w, e: e.tag in ("b", "i") and w.is_empty(e)
    and any(a.tag in ("div", "section") for a in w.above(e)),
    "div:not(section div, .x)": lambda w, e: e.tag == "div" and not cls(e, "x") and not any(a.tag == "section" for a in w.above(e)),
    ":nth-child(2 of .x)": lambda w, e: cls(e, "x") and sum(cls(x, "x") for x in w.before(e)) == 1,
    "b:nth-last-child(odd of b, i)": lambda w, e: e.tag == "b" and sum(x.tag in "bi" for x in w.after(e)) % 2 == 0,
    "body > :empty, :root > body > div:first-child:has([title])": lambda w, e: e in w.parent and (
        (w.parent[e].tag == "body" and w.is_empty(e))
        or (e.tag == "div" and w.parent[e].tag == "body" and not w.before(e) and any(x.get("title") for x in w.below(e)))),
    "div:has(:not(b):last-child) ~ i": lambda w, e: e.tag == "i" and any(
        d.tag == "div" and any(x.tag != "b" and w.is_last(x) for x in w.below(d)) for d in w.before(e)),
}


@pytest.fixture(scope="module")
def pages(spark):
    draw = random.Random(11)
    made = [made_page(draw, draw.randint(0, 70)) for _ in range(120)]
    return made, spark.createDataFrame(list(enumerate(made)), "i int, html string")


def test_selectors_that_look_ahead(spark, pages):
    made, df = pages
    assert all(looks_ahead(parse(s)) for s in CSS)
    needs = NodeNeeds(everything=True, selectors=frozenset(CSS))
    pos = lambda s: F.transform(F.filter("nodes", compile_selector(s).matches), lambda n: n.pos)
    rows = shred(df, needs, ["i"]).select("i", *[pos(s).alias(f"s{k}") for k, s in enumerate(CSS)]).collect()
    found = dict.fromkeys(CSS, 0)
    for row in rows:
        walk = Walk(made[row.i])
        for k, (selector, test) in enumerate(CSS.items()):
            want = [at for at, e in enumerate(walk.all) if test(walk, e)]
            assert row[f"s{k}"] == want, (selector, made[row.i])
            found[selector] += len(want)
    assert min(found.values()) > 3, found


def test_only_candidates_are_kept(spark):
    """Pruned to what may match, the same nodes are found."""
    df = spark.createDataFrame([("<ul><li>a<b>x</b><li>b</ul><p><i></i>",)], "html string")
    for selector, want in (("li:has(b)", 1), ("p > :empty", 1), ("li:last-child", 1), ("li:not(:has(b))", 1)):
        compiled = compile_selector(selector)
        kept = shred(df, compiled.needs(), []).first().nodes
        assert sum(selector in n.hits for n in kept) == want
        assert len(kept) <= 8


def test_long_pages_take_one_pass_per_compound():
    tree = PageTree()
    top = tree.add("body", {}, -1, 0)
    for _ in range(20_000):
        tree.add("b", {}, tree.add("div", {}, top, 0), 0)
    chains = parse("div:has(> b):not(:has(i)) ~ div:nth-last-child(2n of div) > b:only-child")
    assert len(list(tree.settle([("s", chains)]))) == 9_999  # the first has none before it


def texts(walk, elements):
    return list(dict.fromkeys(t for e in walk.all if e in set(elements) and (t := walk.text(e))))


def step(walk, name, near):
    """Elements of a tag that ``near`` finds from some element."""
    return [x for e in walk.all if e.tag == name for x in near(e)]


XPATH = {
    "//b/following-sibling::i": lambda w: step(w, "b", lambda b: [x for x in w.after(b) if x.tag == "i"]),
    "//div[b]/i": lambda w: step(w, "div", lambda d: [x for x in d if x.tag == "i"] if any(x.tag == "b" for x in d) else []),
    "//em/..": lambda w: step(w, "em", lambda e: [w.parent[e]]),
    "//div/b[position()<3]": lambda w: step(w, "div", lambda d: [x for x in d if x.tag == "b"][:2]),
    "//b|//i": lambda w: [e for e in w.all if e.tag in ("b", "i")],
    "//div[contains(text(),'1')]": lambda w: [e for e in w.all if e.tag == "div" and "1" in "".join(w.own_texts(e)[:1])],
    "//*[@class and @title]": lambda w: [e for e in w.all if e.get("class") and e.get("title")],
    "//b/ancestor::div[1]": lambda w: step(w, "b", lambda b: [a for a in w.above(b) if a.tag == "div"][:1]),
    "//section//*[not(*)][last()]": lambda w: [
        e for e in w.all if not len(e) and any(a.tag == "section" for a in w.above(e)) and not any(not len(x) for x in w.after(e))
    ],
    "//i/preceding-sibling::*[1][self::b or self::div]": lambda w: step(
        w, "i", lambda i: [x for x in w.before(i)[-1:] if x.tag in ("b", "div")]),
    "(//div | //section)[@title='x']/b[2]": lambda w: [
        x for e in w.all if e.tag in ("div", "section") and e.get("title") == "x" for x in [c for c in e if c.tag == "b"][1:2]],
    "//div[count(.//b) > 1 and normalize-space()]": lambda w: [
        e for e in w.all if e.tag == "div" and sum(x.tag == "b" for x in w.below(e)) > 1 and w.text(e)],
    "//b/following::em": lambda w: [
        e for k, e in enumerate(w.all) if e.tag == "em" and any(b.tag == "b" and b not in w.above(e) for b in w.all[:k])],
}


def test_paths_of_many_elements(spark, pages):
    made, df = pages
    fields = [{"name": f"x{k}", "xpath": p, "many": True} for k, p in enumerate(XPATH)]
    fields += [{"name": f"y{k}", "xpath": p} for k, p in enumerate(XPATH)]
    rows = extract_fields(df.withColumn("url", F.lit("https://a.org/")), read_fields(fields), ["i"]).collect()
    found = dict.fromkeys(XPATH, 0)
    for row in rows:
        walk = Walk(made[row.i])
        for k, (path, elements) in enumerate(XPATH.items()):
            want = texts(walk, elements(walk))
            assert (row[f"x{k}"] or []) == want, (path, made[row.i])
            assert (row[f"y{k}"] or "") == (want[0] if want else ""), (path, made[row.i])
            found[path] += len(want)
    assert min(found.values()) > 1, found


@pytest.mark.parametrize(
    "path,scalar,kind",
    [
        ("//a[@b='x | y']/@href | (//p)[2]/text()", False, "strings"),
        ("(//a/@href | //b)[1]", False, "mixed"),
        ("//p/node()", False, "mixed"),
        ("//a/attribute::href", False, "strings"),
        ("((//main//h1))[1]/..", False, "elements"),
        ("//div[@id='a' and b or c]", False, "elements"),
        ("id('x')/b", False, "elements"),
        ("count(//a)", True, None),
        ("normalize-space((//main//h1)[1])", True, None),
        ("//a = 'x'", True, None),
        ("(count(//a) + 1)", True, None),
        ("//a[1] and //b", True, None),
    ],
)
def test_what_a_path_gives(spark, path, scalar, kind):
    xp.check(path)
    assert xp.is_scalar(path) == scalar
    if kind:
        assert xp._kind(path) == kind


def test_mixed_nodes_and_scripts(spark):
    html = "<p>a<b>c</b>d</p><a href='/x'>L</a><script>var x = 1;</script><p> </p><p>e</p>"
    df = spark.createDataFrame([("https://a.org/", html)], "url string, html string")
    paths = {
        "//p/node()": ["a", "c", "d", "e"],
        "//a/@href | //b": ["c", "/x"],
        "(//a/@href | //p)[2]": ["/x"],
        "//script[contains(., 'var')]": ["var x = 1;"],
        "//p[2]/preceding::script": ["var x = 1;"],
        "concat(//b, '-', //a/@href)": ["c-/x"],
        "//a/@*": ["/x"],
    }
    fields = [{"name": f"m{k}", "xpath": p, "many": True} for k, p in enumerate(paths)]
    fields += [{"name": f"s{k}", "xpath": p} for k, p in enumerate(paths)]
    got = extract_fields(df, read_fields(fields), ["url"]).first()
    for k, (path, want) in enumerate(paths.items()):
        assert got[f"m{k}"] == want and got[f"s{k}"] == want[0], path
    # The first paragraph with text, not the first paragraph.
    one = extract_fields(df, read_fields([{"name": "f", "xpath": "//p[position()>1]"}]), ["url"]).first()
    assert one.f == "e"
