"""Leads, components, throttle, sources, sinks, ledger, modules and streams."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from sitelens.operators import jobs as J
from sitelens.operators.components import connected_components
from sitelens.operators.context import join_context
from sitelens.operators.leads import clean_leads, prepare_leads, read_settings, with_groups
from sitelens.operators.limits import running_total
from sitelens.operators.modules import register_module, run_modules
from sitelens.operators.skew import salted_join
from sitelens.operators.throttle import runs_of, throttle
from sitelens.sources import ledger, seeds, sinks
from sitelens.sources.pages import gate_pages, number_pages, page_archive, store_raw_pages
from sitelens.streaming.jobs import throttle_stream

LEAD_COLUMNS = "captain string, fleet string, site string, email string, contact_page_url string, profile_url string, source_directory string"
SETTINGS = {
    "rename_fields": {"fleet": "owner", "site": "url"},
    "include_fields": ["captain", "owner", "url", "email", "contact_page_url", "source_directory"],
    "sort_fields": ["email", "owner"],
}


def leads(spark, *rows):
    return spark.createDataFrame(
        [(f"Captain {i}", "Northern Lines", w, e, c, "", "") for i, (w, e, c) in enumerate(rows)], LEAD_COLUMNS
    )


def test_lead_cleaning(spark):
    rows = leads(
        spark,
        ("harbor-lines.test", "crew@harbor-lines.test", "https://harbor-lines.test/write"),
        ("http://www.harbor-lines.test", "CREW@Harbor-Lines.test ", ""),
        ("https://barge.test/fleet/", "a@barge.test", "https://barge.test/talk"),
        ("https://barge.test/", " A@BARGE.TEST", ""),
    )
    got = clean_leads(rows, SETTINGS)
    barge, harbor = got.rows.collect()
    assert barge["email"] == "a@barge.test" and barge["contact_page_url"] == "https://barge.test/talk"
    assert harbor["email"] == "crew@harbor-lines.test" and harbor["owner"] == "Northern Lines"
    stats = got.stats.first().asDict()
    assert stats == {"total_rows": 4, "filtered_missing_required": 0, "filtered_junk_email": 0,
                     "duplicates_removed": 2, "written": 2}
    strict = clean_leads(
        leads(spark, ("", "q@r.test", ""), ("s.test", "", ""), ("t.test", "k@ingest.sentry.io", ""), ("u.test", "u@u.test", "")),
        {**SETTINGS, "required_fields": ["site", "email"]},
    )
    stats = strict.stats.first()
    assert (stats["filtered_missing_required"], stats["filtered_junk_email"], stats["written"]) == (2, 1, 1)
    assert strict.rows.columns == SETTINGS["include_fields"]
    with pytest.raises(ValueError):
        read_settings({"include_fields": "x"})


def group_sets(spark, rows, schema):
    prepared = prepare_leads(spark.createDataFrame(rows, schema), read_settings({}))
    found = {}
    for r in with_groups(prepared).collect():
        found.setdefault(r["group_id"], set()).add(r["idx"])
    return sorted(map(sorted, found.values()))


def test_duplicate_groups(spark):
    schema = "idx bigint, email string, phone string, phones array<string>, name string"
    a, b, c, d = "2025550001", "2025550002", "2025550003", "2025550009"
    rows = [
        (0, None, f"{a}; {b}", None, "A"), (1, None, None, [b, f"1{c}"], "B"), (2, "", c, [], "C"),
        (3, None, d, None, "D"), (4, "x@y.org", d, None, "E"), (5, None, None, None, "Same Co."),
        (6, None, None, None, "same  co"), (7, None, None, None, " "), (8, None, None, None, None),
    ]
    assert group_sets(spark, rows, schema) == [[0, 1, 2], [3], [4], [5, 6], [7], [8]]


def test_components_against_union_find(spark):
    rng = random.Random(3)
    edges = [(f"n{rng.randrange(120):03}", f"n{rng.randrange(120):03}") for _ in range(90)]
    edges += [(f"c{i:03}", f"c{i + 1:03}") for i in range(40)] + [("hub", f"h{i}") for i in range(30)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u != v:
            ru, rv = find(u), find(v)
            parent[max(ru, rv)] = min(ru, rv)
    want = {x: find(x) for x in parent}
    got = connected_components(spark.createDataFrame(edges, "u string, v string")).collect()
    assert {r["node"]: r["component"] for r in got} == want and len(got) == len(want)


def test_salted_join_equals_plain_join(spark):
    many = spark.range(400).select(F.when(F.col("id") < 300, 1).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("a"))
    few = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 10).alias("b"))
    for how in ("inner", "left"):
        salted = salted_join(many, few, ["k"], how, hot_rows=20, salts=4)
        plain = many.join(few, "k", how)
        assert sorted(map(str, salted.collect())) == sorted(map(str, plain.collect()))


def test_running_total(spark):
    rows = [(i * 7 % 50, i, i % 5) for i in range(200)]
    df = spark.createDataFrame(rows, "t bigint, i bigint, v int")
    got = {r["i"]: r["s"] for r in running_total(df, ["t", "i"], F.col("v"), "s", ranges=7).collect()}
    total = 0
    for t, i, v in sorted(rows):
        assert got[i] == total
        total += v


def test_context_join(spark):
    rows = spark.createDataFrame([("u1", "b.com"), ("u3", "c.com")], "input_url string, website string")
    contexts = spark.createDataFrame(
        [("u1", "a.com", "Ada"), ("u1", "a.org", "Bo"), ("u2", "x", "Y")], "input_url string, website string, name string"
    )
    got = sorted((r["input_url"], r["website"], r["name"] or "") for r in join_context(rows, contexts).collect())
    assert got == [("u1", "b.com", "Ada"), ("u1", "b.com", "Bo"), ("u3", "c.com", "")]


# -- throttle -------------------------------------------------------------------


def greedy(events, n, window):
    taken, verdicts = {}, {}
    for i, client, t in sorted(events, key=lambda e: (e[2], e[0])):
        live = [x for x in taken.get(client or "unknown", []) if x >= t - window]
        verdicts[i] = len(live) < n
        taken[client or "unknown"] = live + [t] if verdicts[i] else live
    return verdicts


def submissions(spark, events):
    base = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    rows = [(i, c, base + datetime.timedelta(seconds=t)) for i, c, t in events]
    return spark.createDataFrame(rows, "submission_id bigint, client_ip string, ts timestamp")


def test_throttle_window_is_inclusive(spark):
    events = [(i, "c", t) for i, t in enumerate([0, 10, 20, 3600, 3601])]
    got = {r.submission_id: r.accepted for r in throttle(submissions(spark, events), 2, 3600).collect()}
    assert got == {0: True, 1: True, 2: False, 3: False, 4: True}


@pytest.mark.parametrize("run_rows", [1_000_000, 40, 9, 0])
def test_throttle_against_a_plain_loop(spark, run_rows):
    rng = random.Random(5)
    events = [(i, rng.choice(["a", "a", "a", "b", None, ""]), rng.randrange(0, 4000)) for i in range(600)]
    want = greedy(events, 3, 250)
    got = throttle(submissions(spark, events), 3, 250, run_rows=run_rows).collect()
    assert {r.submission_id: r.accepted for r in got} == want and len(got) == 600


def test_rounds_follow_the_events(spark):
    """A thousand window-long cells of one client are a few stretches."""
    events = [(i, "c", 10 * i) for i in range(3000)]
    keyed = submissions(spark, events).select(
        F.col("submission_id").alias("__id"), F.col("client_ip").alias("__client"), F.unix_micros("ts").alias("__t")
    )
    cells = runs_of(keyed.withColumn("__cell", F.floor(F.col("__t") / F.lit(30_000_000)).cast("bigint")), 2, 500)
    found = cells.agg(F.count("*").alias("cells"), F.max("__stretch").alias("rounds"), F.max("__run").alias("runs")).first()
    assert (found.cells, found.rounds, found.runs) == (1000, 6, 1)


# -- sources and sinks ------------------------------------------------------------


def test_seed_files(spark, tmp_path):
    (tmp_path / "s.txt").write_text("# c\n\n Example.com \nhttps://b.org/x/\n")
    got = [r.url for r in seeds.read_text_seeds(spark, str(tmp_path / "s.txt")).orderBy("pos").collect()]
    assert got == ["https://example.com/", "https://b.org/x"]
    (tmp_path / "s.csv").write_text(
        "﻿captain,fleet,website\nMira Quist,Northern,Harbor.test\nPer Odum,Southern,https://barge.test/crew/\nStowaway,,\n"
    )
    rows = seeds.read_csv(spark, str(tmp_path / "s.csv"))
    assert rows.columns == ["captain", "fleet", "website"]
    targets = seeds.assemble_targets(seeds.csv_seeds(rows)).orderBy("target_idx")
    assert [r.url for r in targets.collect()] == ["https://harbor.test/", "https://barge.test/crew"]
    contexts = seeds.input_contexts(rows, "website", ["captain", "website", "missing"]).collect()
    assert contexts[0].asDict() == {"input_url": "https://harbor.test/", "captain": "Mira Quist", "website": "Harbor.test"}
    assert "website" not in seeds.input_contexts(rows).columns
    for name, text in (("a.json", '["a.com", "b.com"]'), ("o.json", '{"urls": ["a.com", "b.com"]}')):
        (tmp_path / name).write_text(text)
        got = seeds.read_json_seeds(spark, str(tmp_path / name)).orderBy("pos").collect()
        assert [r.url for r in got] == ["https://a.com/", "https://b.com/"]
    (tmp_path / "bad.json").write_text('{"x": 1}')
    with pytest.raises(Exception, match="urls field"):
        seeds.read_json_seeds(spark, str(tmp_path / "bad.json")).collect()
    with pytest.raises(ValueError):
        seeds.resolve_url_column(["a"], "b")
    with pytest.raises(ValueError):
        seeds.resolve_url_column(["a"])
    empty = seeds.csv_seeds(rows.filter("false"))
    static = spark.createDataFrame([(0, "https://s.org/")], "pos bigint, url string")
    assert [r.url for r in seeds.assemble_targets(empty, static=static).collect()] == ["https://s.org/"]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame(
        [(["one@example.com", "two@example.com", ""], None, {"b": "2", "a": "1"}, 'q "x", y'), (["solo"], 3, None, "")],
        "emails array<string>, n int, extra map<string,string>, t string",
    )
    path = str(tmp_path / "csv")
    sinks.write_csv(rows, path, ["t", "missing"])
    back = seeds.read_csv(spark, path)
    assert back.columns == ["t", "missing", "emails", "n", "extra"]
    got = {r["emails"]: r for r in back.collect()}
    assert got["one@example.com; two@example.com"]["extra"] == '{"a": "1", "b": "2"}'
    assert got["one@example.com; two@example.com"]["t"] == 'q "x", y' and got["solo"]["n"] == "3"
    sinks.write_json(rows, str(tmp_path / "json"), {"flatten_fields": ["emails"], "drop_empty_fields": True})
    lines = sorted(r.value for r in spark.read.text(str(tmp_path / "json")).collect())
    assert lines[0] == '{"emails":"solo","n":3,"t":""}'
    assert '["one@example.com","two@example.com",""]' in lines[1] and '"n"' not in lines[1]
    both = sinks.union_rows(rows.select("n"), rows.select("t"))
    assert both.columns == ["n", "t"] and both.count() == 4


def test_cleaned_output_beside_the_standard_one(spark, tmp_path):
    rows = leads(spark, ("a.org", "a@a.org", ""), ("a.org", "A@a.org", "x"))
    done = sinks.write_with_cleaned(rows, str(tmp_path), {**SETTINGS, "enabled": True, "file_name": "c.csv"})
    assert done["success"] and done["written"] == 1
    assert spark.read.option("header", True).csv(str(tmp_path / "c.csv")).columns == SETTINGS["include_fields"]
    failed = sinks.write_with_cleaned(rows, str(tmp_path), {"enabled": True, "include_fields": "oops"})
    assert not failed["success"] and (tmp_path / "results.csv").exists()


def test_page_gates_and_archive(spark):
    rows = spark.createDataFrame(
        [(1, "http://A.com", "http://a.com/", "text/html", None, "<p>"), (2, "b.com", "https://c.com/", "image/png", None, "x"),
         (3, "c.com", "c.com", None, "timed out", None), (4, "d.com", "https://e.com/", "application/xml", None, "<x>"),
         (5, "https://d.com/", "https://z.com/", "text/html", None, "late")],
        "id int, requested_url string, url string, content_type string, error string, html string",
    )
    gated = gate_pages(rows)
    got = {r["id"]: r for r in gated.collect()}
    assert got[1]["error"] is None and not got[1]["redirected"] and got[1]["requested_url"] == "http://a.com/"
    assert got[2]["error"] == "Unsupported content type: image/png" and got[2]["html"] is None
    assert got[3]["error"] == "timed out" and got[4]["redirected"]
    assert page_archive(gated, "id").filter("requested_url = 'https://d.com/'").first()["id"] == 4


def test_raw_page_store_and_report(spark, tmp_path):
    from sitelens.plans.result import Result

    visits = spark.createDataFrame(
        [("s", 3, "https://a.com/", "<p>"), ("s", 5, "https://a.com/x/y", None), ("s", 9, "https://a.com/x/y?b=1", "<b>")],
        "seed string, visit_rank int, url string, html string",
    )
    store_raw_pages(number_pages(visits), str(tmp_path / "raw"))
    stored = spark.read.parquet(str(tmp_path / "raw")).orderBy("label").collect()
    assert [r.label for r in stored] == ["page_001_home", "page_003_x_y_b_1"]
    result = Result(rows=visits, targets=lambda: visits.groupBy("seed").count())
    assert result.issues is None
    sinks.write_report(result, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report" / "targets")).first().asDict() == {"count": 3, "seed": "s"}


def test_ledger(spark, tmp_path):
    good = tmp_path / "j1"
    good.mkdir()
    (good / "job.json").write_text(
        f'{{"job_id": "j1", "status": "completed", "output_dir": "{good}", "started_at": "2024-01-01T00:00:00Z",'
        ' "finished_at": "2024-01-01T00:00:01.5Z"}'
    )
    (good / "run_report.json").write_text(
        '{"mode": "site_scan", "row_count": 1, "pages_visited": 3, "pages_crawled": 3, "pagination_urls_followed": 1, "duration": "1.234s"}'
    )
    for name, body in (("j2", "{broken"), ("j3", '{"job_id": "j3", "status": "queued", "output_dir": "/none"}'),
                       ("j4", '{"job_id": "j4", "status": "failed", "output_dir": "/n", "started_at": "2024-01-01T00:00:00Z", "finished_at": "2024-01-01T00:00:02Z"}')):
        (tmp_path / name).mkdir()
        (tmp_path / name / "job.json").write_text(body)
    jobs = ledger.read_jobs(spark, str(tmp_path))
    reports = ledger.read_reports(spark, str(tmp_path))
    got = {r["job_id"]: r for r in J.job_status(jobs, reports).collect()}
    assert set(got) == {"j1", "j3", "j4"}
    one = got["j1"]
    assert (one["progress_pages_scanned"], one["progress_records_extracted"], one["progress_pagination_pages"]) == (3, 1, 1)
    assert one["run_duration"] == "1.234s" and one["records_extracted"] == 1
    assert got["j3"]["progress_pages_scanned"] is None and got["j3"]["current_phase"] == "queued"
    assert got["j4"]["run_duration"] == "2.000s" and got["j4"]["progress_records_extracted"] == 0


def test_job_rules(spark):
    now = F.lit("2024-01-04 00:00:00").cast("timestamp")
    jobs = spark.createDataFrame(
        [("run", "running", "2024-01-03 23:55:00", None, True), ("dead", "running", "2024-01-03 23:59:30", None, None),
         ("wait", "queued", None, None, None), ("old", "completed", "2023-12-31 00:00:00", "2024-01-01 00:00:00", None)],
        "job_id string, status string, started_at string, finished_at string, worker_alive boolean",
    ).withColumns({c: F.col(c).cast("timestamp") for c in ("started_at", "finished_at")}).withColumn("created_at", F.col("started_at"))
    late = {r.job_id: r.failure_reason for r in J.refresh_status(jobs, now).collect()}
    assert late == {"run": "limit_exceeded", "dead": None, "wait": None, "old": None}
    stale = {r.job_id: (r.status, r.failure_reason) for r in J.recover_stale(jobs, now).collect()}
    assert stale == {"run": ("running", None), "dead": ("failed", "interrupted_run"),
                     "wait": ("failed", "service_restarted"), "old": ("completed", None)}
    assert [r.job_id for r in J.expired_jobs(jobs, now, 24).collect()] == ["old"]
    rows = spark.createDataFrame(
        [(0, "directory_list", 0, ["no_next_page_found"], None), (3, "site_scan", 0, None, None), (0, "site_scan", 2, [], ["x: 429"]), (0, "site_scan", 0, [], ["?"])],
        "row_count int, mode string, listing_count int, stops array<string>, errors array<string>",
    )
    reason = J.report_failure(F.col("row_count"), F.col("mode"), F.col("listing_count"), F.col("stops"), F.col("errors"),
                              F.lit(None).cast("map<string,int>"), F.lit(None).cast("boolean"))
    assert [r.x for r in rows.select(reason.alias("x")).collect()] == [
        "pagination_selector_not_found", None, "blocked_by_site", "no_results_found"]
    texts = spark.createDataFrame([("403 Forbidden - Cloudflare challenge",), ("Timed out",), ("getaddrinfo",), ("extract x",), (None,)], "m string")
    assert [r.x for r in texts.select(J.error_class(F.col("m")).alias("x")).collect()] == [
        "blocked_by_site", "timeout", "connection_failed", "extraction_failed", "extraction_failed"]
    done = spark.createDataFrame([("a", "completed", "x"), ("b", "completed", "y"), ("c", "failed", "z"), ("a", "completed", "x")], "job_id string, status string, output_dir string")
    reports = spark.createDataFrame([("x", 3), ("y", -1), ("z", 9)], "output_dir string, row_count int")
    assert J.job_stats(done, reports).first().asDict() == {"jobs_run": 3, "completed_scrapes": 2, "records_extracted": 3}


def test_cleaner_modules(spark):
    register_module("test.drop", lambda df, options: df.filter(F.col("city") != options["city"]))
    rows = spark.createDataFrame(
        [("Quay Lines", "CREW@QUAY.EXAMPLE", "ghent"), ("X", "Y", "rome")], "law_firm string, email string, city string"
    )
    got, seen = run_modules(
        rows,
        [{"module": "core.rename_columns", "options": {"mapping": {"law_firm": "firm_name"}}},
         {"module": "text.normalize_case", "options": {"columns": ["email"], "case": "lower"}},
         {"module": "test.drop", "options": {"city": "rome"}}],
    )
    assert [r.asDict() for r in got.collect()] == [{"firm_name": "Quay Lines", "email": "crew@quay.example", "city": "ghent"}]
    assert [(name, o.get["rows"]) for name, o in seen] == [
        ("rows_loaded", 2), ("core.rename_columns", 2), ("text.normalize_case", 2), ("test.drop", 1)]
    with pytest.raises(ValueError):
        run_modules(rows, [{"module": "nope"}])
