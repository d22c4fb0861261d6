"""Text functions and transforms, against Python where Python is the rule."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sitelens.functions import contacts, text
from sitelens.functions.transforms import java_replacement, register_transform, titlecase
from sitelens.operators.records import process_records, transform_warnings
from sitelens.plans.spec import read_fields

SLOW = [HealthCheck.function_scoped_fixture, HealthCheck.too_slow]


def column(spark, values, build, kind="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    return [r.x for r in df.select(build(F.col("v")).alias("x")).collect()]


spaces = st.text(alphabet="ab .\t\n\x1c\x1f\x85\xa0  　​", max_size=12)


@settings(max_examples=5, deadline=None, suppress_health_check=SLOW)
@given(st.lists(spaces, min_size=50, max_size=80))
def test_whitespace_follows_python(spark, values):
    assert column(spark, values, text.clean_whitespace) == [" ".join(v.split()) for v in values]
    assert column(spark, values, text.strip) == [v.strip() for v in values]


EMAIL = re.compile(r"[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}", re.I)
PHONE = re.compile(r"(?:\+?1[\s\-.]?)?(?:\(?\d{3}\)?[\s\-.]?)\d{3}[\s\-.]?\d{4}")


def distinct(found):
    return list(dict.fromkeys(f.strip() for f in found if f.strip()))


@settings(max_examples=6, deadline=None, suppress_health_check=SLOW)
@given(st.lists(st.text(alphabet="aB1.@-+ c(d)2345\n", max_size=40), min_size=60, max_size=90))
def test_emails_and_phones_follow_python(spark, values):
    values = [*values, "a@b.com.c@d.org", "x" * 20000, '<img src="logo@2x.png">', "1 (410) 555-0100 4105550100"]
    assert column(spark, values, text.extract_emails) == [distinct(EMAIL.findall(v)) for v in values]
    assert column(spark, values, text.extract_phones) == [distinct(PHONE.findall(v)) for v in values]


def test_address_follows_python(spark, sf_dir):
    pattern = re.compile(
        r"\b\d{1,6}\s+[A-Z0-9][A-Z0-9\s.,#-]{6,120}\b(?:,\s*[A-Z .'-]+,\s*[A-Z]{2}\s+\d{5}(?:-\d{4})?)?", re.I
    )
    docs = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    docs += ["at 12 Main Street, Suite 4, Austin, TX 78701-1234 ok", "7 é", ""]

    def expected(doc):
        found = pattern.search(doc)
        return " ".join(found.group(0).split()) if found else None

    assert column(spark, docs, contacts.address_in_text) == [expected(d) for d in docs]


@pytest.mark.parametrize("value", ["o'neil-smith", "they're 3rd-x", "ÉCOLE d'été", "", "a1b c"])
def test_titlecase_follows_python(spark, value):
    assert column(spark, [value], titlecase) == [value.title()]


def test_contact_values(spark):
    assert column(spark, ["1 (410) 555-0100; 410.555.0100 / 12"], lambda c: contacts.normalize_phones(F.array(c))) == [["4105550100"]]
    assert column(spark, ["Smith & Sons, LLC."], contacts.normalize_company) == ["smith sons llc"]
    names = spark.createDataFrame(
        [("Acme | Home - x", []), ("T", ["Acme Plumbing"]), ("A - B | C", ["One"]), ("", []), (" - x", ["a b c d e f g h i"])],
        "t string, h array<string>",
    ).select(contacts.derive_business_name(F.col("t"), F.col("h")).alias("n"))
    assert [r.n for r in names.collect()] == ["Acme", "Acme Plumbing", "A - B", None, None]
    assert column(spark, ["a_20240101_120000_20240102_130000", "_20240101_120000"], text.strip_trailing_timestamp) == ["a", "_20240101_120000"]
    assert column(spark, ["  Main Run! ", "%%"], text.slugify) == ["main_run", "run"]


def test_transform_chain(spark):
    rows = spark.createDataFrame(
        [("\told HERON of ghent ", "unknown", "Berth No. 14, north", ["Red ", "unknown", "red"], None)],
        "boat string, port string, berth string, colours array<string>, crew array<string>",
    )
    fields = read_fields(
        {
            "boat": {"transforms": ["collapse_whitespace", "titlecase", {"name": "strip_suffix", "value": " Of Ghent"}]},
            "port": {"transforms": ["trim", {"type": "default_if_empty", "value": "at sea"}, "uppercase"]},
            "berth": {
                "transforms": [
                    {"name": "strip_prefix", "value": "Berth "},
                    {"name": "regex_extract", "pattern": r"(?P<berth_no>\d+), (\w+)", "group": "berth_no"},
                    {"name": "regex_replace", "pattern": "^", "replacement": "#"},
                ]
            },
            "colours": {"transforms": ["lowercase", "trim"], "many": True},
            "crew": {"many": True, "transforms": [{"name": "default_if_empty", "value": "none"}]},
            "flag": {"default": "plain"},
        }
    )
    got = process_records(rows, fields, ["unknown"]).first().asDict()
    assert got == {
        "boat": "Old Heron", "port": "AT SEA", "berth": "#14", "colours": ["red"], "crew": ["none"], "flag": "plain",
    }


UNUSABLE = [
    {"pattern": r"(J)?(?(1)o|x)"},
    {"pattern": "o", "replacement": r"\3"},
    {"pattern": "o", "replacement": r"\g<zz>"},
    {"pattern": "o", "replacement": 7},
    {"pattern": 7},
    {"pattern": "("},
]


@pytest.mark.parametrize("options", UNUSABLE, ids=str)
def test_no_transform_can_end_a_job(spark, options):
    rows = spark.createDataFrame([("Jo",), (None,)], "x string")
    fields = read_fields([{"name": "x", "transforms": [{"name": "regex_replace", **options}]}])
    assert process_records(rows, fields).first()["x"] == "Jo"
    assert [r["count"] for r in transform_warnings(rows, fields).collect()] == [1]


@pytest.mark.parametrize(
    "pattern,replacement",
    [(r"(?P<first_name>\w+)", r"<\g<first_name>>"), ("[[x]", "-"), ("[]a]", "-"), ("[a&&b]", "-"),
     (r"(?P<a_b>b)(?P=a_b)", r"\g<1>0"), ("b{,2}a", "-"), (r"\w\Z", "-")],
)
def test_python_patterns_work(spark, pattern, replacement):
    rows = spark.createDataFrame([("ab[x&]bba",)], "x string")
    step = {"name": "regex_replace", "pattern": pattern, "replacement": replacement}
    fields = read_fields([{"name": "x", "transforms": [step]}])
    assert process_records(rows, fields).first()["x"] == re.sub(pattern, replacement, "ab[x&]bba")


def test_unusable_transforms_keep_the_value(spark):
    rows = spark.createDataFrame([("a", ["x", ""]), (None, ["y"])], "email string, l array<string>")
    fields = read_fields(
        [
            {"name": "email", "transforms": ["nope", {"name": "regex_replace", "pattern": "("}]},
            {"name": "l", "many": True, "transforms": ["nope"]},
        ]
    )
    assert process_records(rows, fields).first()["email"] == "a"
    got = {(r["field"], r["count"]) for r in transform_warnings(rows, fields).collect()}
    assert got == {("email", 1), ("l", 2)} and transform_warnings(rows, fields).count() == 3


def test_a_registered_transform(spark):
    register_transform("shout", lambda c, o: F.concat(c, F.lit(o.get("mark", "!"))))
    rows = spark.createDataFrame([("a",)], "x string")
    fields = read_fields([{"name": "x", "transforms": [{"name": "shout", "mark": "?"}]}])
    assert process_records(rows, fields).first()["x"] == "a?"


@pytest.mark.parametrize("pattern,replacement", [(r"(\w)(\d)", r"\2\1"), (r"(?P<a>b)", r"<\g<a>>"), ("b", "$1"), ("b", r"\\x")])
def test_replacements_follow_python(spark, pattern, replacement):
    from sitelens.functions.transforms import java_pattern

    want = re.sub(pattern, replacement, "ab1b2")
    got = column(spark, ["ab1b2"], lambda c: F.regexp_replace(c, java_pattern(pattern), java_replacement(replacement, {"a": 1})))
    assert got == [want]
