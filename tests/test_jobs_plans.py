"""Whole jobs on small page archives with known results."""

from pyspark.sql import functions as F

from sitelens.operators import crawl as crawling
from sitelens.plans.directory import directory_detail, directory_list
from sitelens.plans.site_scan import site_scan

SCHEMA = "requested_url string, url string, status_code int, error string, html string"
SITE = "https://example.com"

BERTHS = """
<table id="berths"><tr class="boat"><th>Sea Otter</th><td><a class="more" href="otter.html">log</a></td>
  <td class="length">9 m</td><td class="port">Ghent</td></tr>
<tr class="boat"><th>Old Heron</th><td><a class="more" href="//harbor.test/heron">log</a></td>
  <td class="length">14 m</td></tr></table>
"""
LIST_FIELDS = [
    {"name": "boat", "selector": "tr > th"},
    {"name": "log", "selector": "a.more", "attribute": "href"},
    {"name": "length", "selector": "td:nth-child(3)"},
    {"name": "port", "selector": ".port", "default": "at sea"},
]


def archive(spark, pages):
    rows = []
    for url, html in pages.items():
        if html.startswith("!"):
            rows.append((url, url, 404, html[1:], None))
        else:
            rows.append((url, url, 200, None, html))
    return spark.createDataFrame(rows, SCHEMA)


def targets(spark, *urls):
    return spark.createDataFrame(list(enumerate(urls)), "target_idx bigint, target string")


def seeds(spark, *urls):
    return spark.createDataFrame(list(enumerate(urls)), "target_idx bigint, url string")


def dicts(df):
    return [r.asDict() for r in df.collect()]


def spec(**changes):
    base = {
        "mode": "directory_list",
        "extraction": {"record_selector": {"css": "tr.boat"}, "fields": LIST_FIELDS},
    }
    return {**base, **changes}


def paging(n):
    return {"enabled": True, "max_pages": n, "next_page": "a.next"}


def boats(*names):
    return "<table>" + "".join(f"<tr class='boat'><th>{n}</th></tr>" for n in names) + "</table>"


def test_listing_records(spark):
    quay = f"{SITE}/quay/north"
    got = directory_list(archive(spark, {quay: BERTHS}), targets(spark, quay), spec())
    otter, heron = dicts(got.rows)
    assert (otter["boat"], otter["length"], otter["port"]) == ("Sea Otter", "9 m", "Ghent")
    assert otter["log"] == f"{SITE}/quay/otter.html" and heron["log"] == "https://harbor.test/heron"
    assert heron["port"] == "at sea" and heron["input_url"] == quay
    assert got.targets.first()["stop_reason"] == "pagination_disabled"


def test_pagination_stops(spark):
    def leads_to(boat, href):
        return boats(boat) + f"<p><a class='next' href='{href}'>more</a></p>"

    pages = {
        f"{SITE}/north": leads_to("Tern", "north/2"),
        f"{SITE}/north/2": boats("Gull"),
        f"{SITE}/ring": leads_to("Loon", "/ring/b"),
        f"{SITE}/ring/b": leads_to("Coot", "../ring"),
        f"{SITE}/sunk": "!410",
        f"{SITE}/odd": leads_to("Rail", "http://[::1/"),
    }
    starts = ["/north", "/ring", "/sunk", "/odd", "/nowhere"]
    got = directory_list(
        archive(spark, pages),
        targets(spark, *[SITE + s for s in starts]),
        spec(pagination=paging(5)),
    )
    reports = sorted(dicts(got.targets), key=lambda r: r["target_idx"])
    assert [r["stop_reason"] for r in reports if r["target_idx"] != 3] == [
        "no_next_page_found", "duplicate_next_page_detected", "fetch_failure", "fetch_failure",
    ]
    assert reports[0]["pages_visited"] == 2 and reports[0]["pagination_urls_followed"] == 1
    rows = dicts(got.rows)
    assert [r["boat"] for r in rows] == ["Tern", "Gull", "Loon", "Coot", "Rail"]
    assert rows[1]["source_url"] == f"{SITE}/north/2"
    short = directory_list(
        archive(spark, pages), targets(spark, f"{SITE}/north"), spec(pagination=paging(1))
    )
    assert short.targets.first()["stop_reason"] == "max_pages_reached"


def test_unreadable_pages_are_failed_pages(spark, monkeypatch):
    broken = boats("Kept") + "<![x<p>tail"
    pages = archive(spark, {f"{SITE}/a": broken, f"{SITE}/b": boats("Fine")})
    got = directory_list(pages, targets(spark, f"{SITE}/a", f"{SITE}/b"), spec())
    assert [r["boat"] for r in dicts(got.rows)] == ["Kept", "Fine"]
    assert got.issues.count() == 0
    lost = pages.withColumn("error", F.when(F.col("url").endswith("a"), "reader stopped"))
    got = directory_list(lost, targets(spark, f"{SITE}/a", f"{SITE}/b"), spec())
    totals = got.targets.agg(F.sum("pages_succeeded"), F.sum("pages_failed")).first()
    assert tuple(totals) == (1, 1) and got.issues.count() == 1


CREW = f"{SITE}/crew"
DETAIL_PAGES = {
    CREW: """<dl><dt class="hand">Mira Quist<dd class="rank">bosun<dd><a rel="bio" href="/hands?id=7">p</a></dl>
      <dl><dt class="hand">Per Odum<dd class="rank">cook<dd><a rel="bio" href="/hands?id=8">p</a></dl>
      <dl><dt class="hand">Stowaway</dl>""",
    f"{SITE}/hands?id=7": """<section><span data-mail="mira@harbor.test"></span>
      <em class="note">knots and charts</em><dt class="hand">other</dt></section>""",
    f"{SITE}/hands?id=8": "!503 Unavailable",
}
DETAIL_SPEC = {
    "mode": "directory_detail",
    "extraction": {
        "record_selector": {"css": "dl"},
        "fields": [
            {"name": "hand", "selector": "dt"},
            {"name": "rank", "selector": "dd.rank"},
            {"name": "bio_url", "selector": "a[rel=bio]", "attribute": "href"},
        ],
        "detail_page": {
            "enabled": True,
            "url_field": "bio_url",
            "fields": [
                {"name": "mail", "selector": "[data-mail]", "attribute": "data-mail"},
                {"name": "note", "selector": "em"},
                {"name": "rank", "selector": "h6"},
            ],
        },
    },
}


def test_detail_enrichment_keeps_base_rows(spark):
    got = directory_detail(archive(spark, DETAIL_PAGES), targets(spark, CREW), DETAIL_SPEC)
    mira, per, stowaway = dicts(got.rows)
    assert (mira["mail"], mira["note"], mira["rank"]) == ("mira@harbor.test", "knots and charts", "bosun")
    assert mira["detail_url"] == f"{SITE}/hands?id=7"
    assert (per["hand"], per["rank"], per["mail"]) == ("Per Odum", "cook", None)
    assert stowaway["bio_url"] is None
    report = got.targets.first()
    assert (report["listing_count"], report["detail_pages_attempted"]) == (3, 2)
    assert (report["detail_pages_successful"], report["detail_pages_failed"]) == (1, 1)
    assert report["pages_crawled"] == 3
    issues = {r["category"] for r in got.issues.collect()}
    assert issues == {"detail_page_fetch_failed"}


def test_detail_cap(spark):
    pages = {**DETAIL_PAGES, f"{SITE}/hands?id=8": "<b data-mail='per@harbor.test'></b>"}
    got = directory_detail(
        archive(spark, pages), targets(spark, CREW), {**DETAIL_SPEC, "limits": {"max_detail_pages": 1}}
    )
    assert [r["mail"] for r in dicts(got.rows)] == ["mira@harbor.test", None, None]
    limits = got.limits.first()
    assert limits["max_detail_pages_hit"] and limits["detail_pages_skipped_due_to_limit"] == 1
    counts = {r["category"]: r["n"] for r in got.issues.groupBy("category").agg(F.count("*").alias("n")).collect()}
    assert counts == {"detail_page_limit_skipped": 1, "max_detail_pages_reached": 1}


def test_record_cap(spark):
    three = boats("Ide", "Orfe", "Roach")
    pages = archive(spark, {f"{SITE}/one": three, f"{SITE}/two": three, f"{SITE}/none": "<p>x</p>"})
    got = directory_list(
        pages, targets(spark, f"{SITE}/one", f"{SITE}/two"), spec(limits={"max_records": 2})
    )
    assert len(dicts(got.rows)) == 2
    limits = got.limits.first()
    assert limits["max_records_hit"] and limits["records_truncated"] == 1
    assert got.targets.count() == 1  # the job stops at the target that hit the cap
    exact = directory_list(
        pages, targets(spark, f"{SITE}/one", f"{SITE}/none", f"{SITE}/two"), spec(limits={"max_records": 3})
    )
    assert exact.limits.first()["max_records_hit"] and exact.limits.first()["records_truncated"] == 0
    assert exact.targets.count() == 2
    under = directory_list(pages, targets(spark, f"{SITE}/one"), spec(limits={"max_records": 3}))
    assert not under.limits.first()["max_records_hit"]


def test_rendered_directory(spark):
    guild = f"{SITE}/guild"
    pages = archive(
        spark,
        {
            guild: "<nav><i data-x><a href='/smiths/3'>three</a></i><i data-x><a href='/smiths/4'>four</a></i>"
            "<i data-x><a href='/smiths/3'>three again</a></i><a href='/rules'>rules</a></nav>",
            f"{SITE}/smiths/3": "<article><h4>Forge Three</h4><a href='tel:+4790000003'>ring</a>"
            "<a href='https://three.test/'>Shop</a></article>",
            f"{SITE}/smiths/4": "<article><h4>Forge Four</h4></article>",
        },
    )
    got = directory_detail(
        pages,
        targets(spark, guild),
        {
            "mode": "directory_detail",
            "extraction": {
                "fields": [],
                "detail_page": {
                    "enabled": True,
                    "url_field": "detail_url",
                    "fields": [
                        {"name": "forge", "xpath": "normalize-space((//article/h4)[1])"},
                        {"name": "ring", "xpath": "(//a[starts-with(@href, 'tel:')]/@href)[1]"},
                        {"name": "shop", "xpath": "(//a[normalize-space()='Shop']/@href)[1]"},
                    ],
                },
            },
            "metadata": {
                "renderer": "playwright", "private_only": True,
                "playwright": {"profile_link_selector": "i[data-x] > a"},
            },
        },
    )
    rows = {r["profile_url"]: r for r in dicts(got.rows)}
    three, four = rows[f"{SITE}/smiths/3"], rows[f"{SITE}/smiths/4"]
    assert (three["forge"], three["ring"], three["shop"]) == ("Forge Three", "tel:+4790000003", "https://three.test/")
    assert three["detail_url"] == f"{SITE}/smiths/3" and three["source_directory"] == guild
    assert four["forge"] == "Forge Four" and four["ring"] is None
    report = got.targets.first()
    assert report["listing_count"] == len(rows) == report["detail_pages_successful"]


def test_crawl_order_and_filters(spark):
    pages = archive(
        spark,
        {
            f"{SITE}/": "<ol><li><a href='/crew'>Our crew</a><li><a href='/visit/contact'>Write to us</a>"
            "<li><a href='/shop/contact'>Shop</a><li><a href='/tides'>Tides</a>"
            "<li><a href='https://elsewhere.test/contact'>x</a></ol>",
            f"{SITE}/visit/contact": "<p>letters</p>",
            f"{SITE}/crew": "<p>crew</p>",
        },
    )
    got = site_scan(
        pages,
        seeds(spark, f"{SITE}/"),
        {
            "crawl": {
                "max_pages": 3, "include_url_keywords": ["crew", "contact"],
                "exclude_url_keywords": ["shop"],
            },
            "extraction": {"fields": [{"name": "page_title", "type": "page_title"}]},
        },
    )
    visits = [r["url"] for r in got.visits.orderBy("visit_rank").collect()]
    assert visits[0] == f"{SITE}/" and set(visits[1:]) == {f"{SITE}/visit/contact", f"{SITE}/crew"}


def test_site_scan_with_contact_summary_and_contexts(spark):
    home = "https://mill-test.org"
    pages = archive(
        spark,
        {
            f"{home}/": '<title>Mill</title><a href="/contact">Contact</a> <a href="mailto:ada@mill-test.org">ada@mill-test.org</a><a href="/missing">m</a>',
            f"{home}/contact": "info@mill-test.org (503) 555-0177",
        },
    )
    contexts = spark.createDataFrame(
        [(f"{home}/", "Ada", "T"), (f"{home}/", "Bo", "T")], "input_url string, name string, page_title string"
    )
    got = site_scan(
        pages,
        seeds(spark, f"{home}/"),
        {
            "crawl": {"max_pages": 4},
            "extraction": {
                "fields": [
                    {"name": "page_title", "type": "page_title"},
                    {"name": "contact_pages", "type": "contact_links", "many": True, "default": []},
                    {"name": "emails", "type": "emails", "many": True, "default": []},
                    {"name": "phones", "type": "phones", "many": True, "default": []},
                    {"name": "social_links", "type": "social_links", "many": True, "default": []},
                ]
            },
            "metadata": {"contact_discovery": {"enabled": True}},
        },
        contexts,
    )
    rows = dicts(got.rows.orderBy("name"))
    assert [r["name"] for r in rows] == ["Ada", "Bo"]
    row = rows[0]
    assert row["email"] == "info@mill-test.org" and row["contact_phone"] == "(503) 555-0177"
    assert row["contact_page_url"] == row["email_found_on"] == f"{home}/contact"
    assert row["emails"] == ["ada@mill-test.org", "info@mill-test.org"]
    assert row["source_urls"] == [f"{home}/", f"{home}/contact"]
    assert row["page_title"] == "Mill" and row["social_links"] == []
    report = got.targets.first()
    assert (report["pages_crawled"], report["pages_failed"], report["error_count"]) == (3, 1, 1)


def test_site_scan_cap_and_unmerged_rows(spark):
    pages = archive(spark, {f"https://{n}.org/": f"<title>{n}</title>" for n in "abc"})
    options = {"extraction": {"fields": [{"name": "page_title", "type": "page_title"}]}}
    got = site_scan(
        pages, seeds(spark, *[f"https://{n}.org/" for n in "abc"]), {**options, "limits": {"max_records": 2}}
    )
    assert [r["page_title"] for r in got.rows.collect()] == ["a", "b"]
    assert got.limits.first()["max_records_hit"]
    flat = site_scan(
        pages, seeds(spark, "https://a.org/"), {**options, "output": {"merge_rows": False}}
    )
    assert flat.rows.first()["page_url"] == "https://a.org/"


def test_rounds_move_neither_archive_nor_state(spark, monkeypatch):
    plans = []
    one_round = crawling.crawl_round

    def noted(*args, **kwargs):
        found = one_round(*args, **kwargs)
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        return found

    monkeypatch.setattr(crawling, "crawl_round", noted)
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        page = "<a href='/a'>a</a><a href='/b'>b</a><a href='/c'>c</a>"
        site_scan(
            archive(spark, {f"{SITE}/{n}": page for n in ("", "a", "b", "c")}),
            seeds(spark, f"{SITE}/"),
            {"crawl": {"max_pages": 3}, "extraction": {"fields": [{"name": "t", "type": "page_title"}]}},
        )
    finally:
        spark.conf.set(key, before)
    # What moves is the popped URLs to the pages, and the answers back to the seeds.
    moved = [line for line in plans[1].splitlines() if "Exchange" in line]
    assert len(plans) == 3 and len(moved) == 2
    assert "pop_url" in moved[1] and "seed" in moved[0]
    assert " t#" not in plans[1] and "f_t" not in plans[1]  # page fields are not read
