"""Seeds, ledgers and reports as files have them: many, split, quoted, broken."""

import datetime
import json
import threading
import time
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from sitelens import catalog
from sitelens.operators import jobs as J
from sitelens.operators.quality import field_coverage, quality_summary
from sitelens.plans.report import run_report
from sitelens.plans.result import Result
from sitelens.sources import files, ledger, seeds, sinks


def urls(df):
    return [r.url for r in df.orderBy("pos").collect()]


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "2k", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_order_is_file_then_line(spark, tmp_path, small_splits):
    """Spark packs splits by size; positions follow the files."""
    want = []
    for name, n in (("a", 3), ("b", 400), ("c", 1), ("d +%20", 90)):
        lines = [f"https://{name[0]}{k}.test/x" for k in range(n)]
        want += lines
        (tmp_path / f"{name}.txt").write_text("# seeds\n\n" + "\n".join(lines) + "\n")
        (tmp_path / f"{name}.csv").write_text("name,url\n" + "".join(f"n,{u}\n" for u in lines))
    assert spark.read.text(str(tmp_path / "*.txt")).rdd.getNumPartitions() > 3
    assert urls(seeds.read_text_seeds(spark, str(tmp_path / "*.txt"))) == want
    for multiline in (True, False):
        assert urls(seeds.read_csv_seeds(spark, str(tmp_path / "*.csv"), multiline=multiline)) == want
    targets = seeds.assemble_targets(seeds.read_text_seeds(spark, str(tmp_path / "*.txt")))
    assert [r.url for r in targets.orderBy("target_idx").collect()] == want


def places(df):
    """(number of the file, place in it, url) of seeds."""
    return [(r.pos // files.FILE_ROWS, r.pos % files.FILE_ROWS, r.url) for r in df.orderBy("pos").collect()]


@pytest.mark.parametrize("size", ["2k", "128m"])
def test_places_are_those_in_the_file(spark, tmp_path, small_splits, size):
    """However files are cut and packed: many in a task, or several tasks for one."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "4m" if size == "128m" else "1")
    want = []
    for file, n in enumerate((3, 400, 1, 90, 2, 5, 7, 1, 2, 3, 4, 5)):
        lines = [f"https://f{file}-{k}.test/x" for k in range(n)]
        want += [(file, 1 + k, u) for k, u in enumerate(lines)]
        (tmp_path / f"{file:02}.txt").write_text("# seeds\n" + "\n".join(lines) + "\n")
    assert places(seeds.read_text_seeds(spark, str(tmp_path / "*.txt"))) == want


def test_places_of_json_items(spark, tmp_path):
    """Many files in one task: each numbers its items from 0."""
    want = []
    for file in range(12):
        found = [f"https://f{file}-{k}.test/x" for k in range(file % 4 + 1)]
        want += [(file, k, u) for k, u in enumerate(found)]
        listed = {"urls": found} if file % 2 else found
        (tmp_path / f"{file:02}.json").write_text(json.dumps(listed))
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() < 12
    assert places(seeds.read_json_seeds(spark, str(tmp_path))) == want


@pytest.mark.parametrize("name", ["seeds_files", "seeds_json"])
def test_files_of_large_ids_stay_apart(spark, tmp_path, name):
    """Page ids of nine and more digits; file 0 has the last hundred of eight digits."""
    first = 10**8 - 100
    pages = spark.range(first, first + 1100).selectExpr("id AS page_id", "concat('https://a.test/', id) AS url")
    pages.unionAll(spark.sql("SELECT 3 * 1000000000000, 'https://b.test/x'")).write.parquet(str(tmp_path / "pages.parquet"))
    rows = catalog.queries()[name](spark, str(tmp_path)).filter("url LIKE '%.test/%'").collect()
    step = 3 if name == "seeds_files" else 1
    for r in rows:
        host, _, page = r.url.partition(".test/")
        want = (11, 0) if host == "https://b" else divmod(int(page) - first, 100)
        assert (r.file, r.place) == (want[0], step * want[1])
    assert len(rows) > 800


@contextmanager
def executors_join(spark):
    """Files are packed otherwise from the first job on, as when executors come or go."""
    key, tracker = "spark.sql.files.minPartitionNum", spark.sparkContext.statusTracker()
    before, begun = spark.conf.get(key, None), len(tracker.getJobIdsForGroup(None))
    left = threading.Event()

    def later():
        while len(tracker.getJobIdsForGroup(None)) == begun and not left.is_set():
            time.sleep(0.001)
        spark.conf.set(key, "1000")

    thread = threading.Thread(target=later)
    thread.start()
    try:
        yield
    finally:
        left.set()
        thread.join()
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def test_places_of_json_items_while_executors_join(spark, tmp_path, small_splits):
    """The paths and the items are read by unlike tasks."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
    want = []
    for file in range(12):
        found = [f"https://f{file}-{k}.test/x" for k in range(file % 4 + 1)]
        want += [(file, k, u) for k, u in enumerate(found)]
        (tmp_path / f"{file:02}.json").write_text(json.dumps(found))
    with executors_join(spark):
        assert places(seeds.read_json_seeds(spark, str(tmp_path))) == want


@pytest.mark.parametrize("kind", ["txt", "csv"])
def test_no_wrong_places_while_executors_join(spark, tmp_path, kind):
    """Lines are counted in one read and numbered in another; unlike reads give no numbers."""
    for file in range(12):
        found = [f"https://f{file}-{k}.test/x" for k in range(file % 4 + 1)]
        (tmp_path / f"{file:02}.{kind}").write_text("\n".join(["# url", *found] if kind == "txt" else ["url", *found]))
    read = seeds.read_text_seeds if kind == "txt" else seeds.read_csv_seeds
    rows = read(spark, str(tmp_path))
    assert rows.count() == 30
    with executors_join(spark), pytest.raises(Exception, match="between two reads"):
        places(rows)
    assert [p[:2] for p in places(rows)][:3] == ([(0, 1), (1, 1), (1, 2)] if kind == "txt" else [(0, 0), (1, 0), (1, 1)])


def test_quoted_line_breaks_are_no_rows(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text('﻿url,note\nhttp://a.org,"two\nlines, ""b"""\n" http://b.org ","\n\n"\n,none\n')
    rows = seeds.read_csv(spark, str(path))
    assert rows.columns == ["url", "note"]
    assert [r.note for r in rows.collect()] == ['two\nlines, "b"', "\n\n", "none"]
    assert urls(seeds.read_csv_seeds(spark, str(path))) == ["http://a.org/", "http://b.org/"]


def test_json_seeds(spark, tmp_path):
    (tmp_path / "a.json").write_text('[\n "a.com",\n 7, {"x": 1}, [], " ", "https://[bad", "b.com"\n]\n')
    (tmp_path / "b.json").write_text('{"urls": ["c.com", "a.com"],\n "urls_note": []}')
    (tmp_path / "c.json").write_text('{"urls": []}')
    got = urls(seeds.read_json_seeds(spark, str(tmp_path / "*.json")))
    assert got[:2] == ["https://a.com/", "https://7/"] and got[4] is None
    assert got[6:] == ["https://b.com/", "https://c.com/", "https://a.com/"]
    targets = seeds.assemble_targets(seeds.read_json_seeds(spark, str(tmp_path / "*.json")))
    listed = [r.url for r in targets.orderBy("target_idx").collect()]
    assert listed[:2] == got[:2] and listed[-2:] == ["https://b.com/", "https://c.com/"]
    assert urls(seeds.read_json_seeds(spark, str(tmp_path / "c.json"))) in ([], [None])
    for text in ('{"x": 1}', '"a.com"', "{broken", '{"urls": "a.com"}'):
        (tmp_path / "wrong.json").write_text(text)
        with pytest.raises(Exception, match="urls field"):
            seeds.read_json_seeds(spark, str(tmp_path / "wrong.json")).collect()


def job(root, name, text):
    (root / name).mkdir()
    (root / name / "job.json").write_text(text)


def test_ledger_with_broken_files(spark, tmp_path):
    job(tmp_path, "a b", json.dumps({"job_id": "1", "status": "completed", "started_at": "2024-01-01T00:00:00+00:00",
                                     "finished_at": "2024-01-01T00:00:01.250000+00:00", "output_dir": f"file://{tmp_path}/a b/"}, indent=2))
    job(tmp_path, "c", '{"job_id": "2", "status": 5, "worker_alive": "yes", "output_dir": null, "more": [1]}')
    job(tmp_path, "d", "{broken")
    job(tmp_path, "e", "")
    job(tmp_path, "f", '[{"job_id": "3"}]')
    job(tmp_path, "g", '{"status": "queued"}')
    jobs = {r.job_id: r for r in ledger.read_jobs(spark, str(tmp_path)).collect()}
    assert set(jobs) == {"1", "2"}
    assert jobs["1"].output_dir == f"{tmp_path}/a b" and jobs["2"].worker_alive is None
    assert (jobs["1"].finished_at - jobs["1"].started_at).total_seconds() == 1.25
    bad = {r.path: (r.problem, r.text) for r in ledger.quarantined_jobs(spark, str(tmp_path)).collect()}
    assert {k.split("/")[-2]: v[0] for k, v in bad.items()} == {
        "d": "not a JSON object", "f": "not a JSON object", "g": "no job_id"
    }  # fmt: skip (Spark lists no files without bytes)
    assert bad[f"{tmp_path}/d/job.json"][1] == "{broken"
    # A run that has written nothing yet.
    for read in (ledger.read_jobs, ledger.read_reports):
        assert read(spark, str(tmp_path / "nothing")).count() == 0
    (tmp_path / "a b" / "run_report.json").write_text('{"row_count": 4, "duration": "1.000s", "pages_visited": 2}')
    (tmp_path / "c" / "run_report.json").write_text("{broken")
    status = J.job_status(ledger.read_jobs(spark, str(tmp_path)), ledger.read_reports(spark, str(tmp_path)))
    got = {r.job_id: r for r in status.collect()}
    assert got["1"].records_extracted == 4 and got["1"].run_duration == "1.000s"
    assert got["2"].records_extracted is None


def made_result(spark):
    rows = spark.createDataFrame([("a", None), ("b", "x"), ("c", "")], "name string, mail string")
    targets = spark.createDataFrame(
        [(0, "s", 4, 3, 1, "no_next_page_found"), (1, "t", 2, 2, 0, "max_pages_reached"), (2, "u", 1, 1, 0, "max_pages_reached")],
        "target_idx int, target string, pages_crawled bigint, pages_succeeded bigint, pages_failed bigint, stop_reason string",
    )
    issues = spark.createDataFrame(
        [("page_fetch_failed", f"p{k}: oops") for k in range(12)] + [("page_fetch_failed", "q: HTTP 403 Forbidden")] * 2
        + [("page_fetch_failed", "r: timed out"), ("max_records_reached", "capped")],
        "category string, message string",
    )
    warnings = spark.createDataFrame([("field_transform", "mail", "mail: x", 3), ("field_transform", "name", "name: y", 1)],
                                     "category string, field string, message string, count bigint")
    cleanup = spark.createDataFrame([("fields_joined", 2), ("fields_flattened", 0)], "action string, count bigint")
    limits = spark.createDataFrame([(500, None, True, 7, False, 0)], "max_records bigint, max_detail_pages bigint, max_records_hit boolean, "
                                   "records_truncated bigint, max_detail_pages_hit boolean, detail_pages_skipped_due_to_limit bigint")
    names = ["name", "mail"]
    return Result(
        fields=names, mode="directory_list", rows=rows, targets=targets, issues=issues, warnings=warnings, cleanup=cleanup,
        limits=limits, coverage=field_coverage(rows, names), summary=quality_summary(rows, names),
    )


def test_nested_report(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    about = {"run_name": "r", "started_at": start, "ended_at": start + datetime.timedelta(seconds=2.5)}
    got = run_report(made_result(spark), **about).first().asDict(recursive=True)
    assert (got["run_name"], got["config_name"], got["mode"], got["duration"]) == ("r", None, "directory_list", "2.500s")
    assert (got["target_count"], got["row_count"], got["pages_crawled"], got["pages_visited"]) == (3, 3, 7, 0)
    assert got["error_count"] == 15  # the cap is no error
    assert got["errors"] == ["q: HTTP 403 Forbidden", "r: timed out", "p0: oops"]
    assert got["pagination_stopped_reasons"] == ["max_pages_reached", "no_next_page_found"]
    found = got["diagnostics"]
    assert found["non_fatal_issue_counts"] == {"page_fetch_failed": 15, "max_records_reached": 1}
    assert found["non_fatal_issue_messages"][0] == {"message": "q: HTTP 403 Forbidden", "count": 2}
    assert len(found["non_fatal_issue_messages"]) == 10 and found["non_fatal_issue_messages"][1]["message"] == "capped"
    assert found["warning_total"] == 4 and found["warning_counts_by_field"] == {"mail": 3, "name": 1}
    assert found["cleanup_actions"] == {"fields_joined": 2}
    assert found["pagination_stop_reason_counts"] == {"max_pages_reached": 2, "no_next_page_found": 1}
    assert got["limits"]["records_truncated"] == 7 and got["limits"]["max_detail_pages"] is None
    metrics = got["quality_metrics"]
    assert metrics["configured_field_coverage"]["mail"] == {"filled": 1, "empty": 2, "fill_rate": 0.333, "empty_rate": 0.667}
    assert metrics["final_output_fields_seen"] == ["name", "mail"] and metrics["configured_fields"] == ["name", "mail"]


def test_report_round_trip(spark, tmp_path):
    """What one module writes the other reads, and the job of the folder finds it."""
    result = made_result(spark)
    sinks.write_results(result, str(tmp_path / "job 1"), run_name="one")
    sinks.write_report(Result(rows=result.rows), str(tmp_path / "job 2"))
    read = {r.output_dir: r for r in ledger.read_reports(spark, str(tmp_path)).collect()}
    assert set(read) == {f"{tmp_path}/job 1", f"{tmp_path}/job 2"}
    want = run_report(result, run_name="one").first().asDict(recursive=True)
    got = read[f"{tmp_path}/job 1"].asDict(recursive=True)
    assert {k: v for k, v in got.items() if k != "output_dir"} == want
    assert read[f"{tmp_path}/job 2"].row_count == 3 and read[f"{tmp_path}/job 2"].target_count == 0
    jobs = spark.createDataFrame([("1", "completed", f"{tmp_path}/job 1")], "job_id string, status string, output_dir string")
    jobs = jobs.withColumns({c: F.lit(None).cast("timestamp") for c in ("started_at", "finished_at")})
    status = J.job_status(jobs, ledger.read_reports(spark, str(tmp_path))).first()
    assert (status.records_extracted, status.crawl_pages_scanned, status.progress_pages_scanned) == (3, 7, 0)
    # An empty run.
    empty = Result(rows=result.rows.limit(0), issues=result.issues.limit(0), targets=result.targets.limit(0))
    none = run_report(empty).first()
    assert (none.row_count, none.error_count, none.errors, none.pagination_stopped_reasons) == (0, 0, [], [])


def test_output_columns_order_results(spark, tmp_path):
    result = Result(columns=["input_url", "mail", "name"], rows=made_result(spark).rows)
    sinks.write_results(result, str(tmp_path / "out"))
    assert seeds.read_csv(spark, str(tmp_path / "out" / "results.csv")).columns == ["input_url", "mail", "name"]
