"""URL filters: pattern rules indexed by their rarest literal token.

A rule is ``host/path``: it fits its host and all subdomains of it when the path of the
URL starts with the path of the rule. A pattern is a regular expression over host and
path together with the literal tokens that every match contains. Both become regular
expressions, filed under that one of their literal tokens which the URLs hold least
often. A URL fetches the rules filed under its own tokens and runs only their
expressions; of the rules that fit, the longest wins (ties: block, then by name), and
patterns decide only where no rule fits.

DataFrame operations only. Defined results: a null URL and one without ``://`` have an
empty host and path, and get the default verdict; repeated rows are judged alike; a
page without a path ("http://a.net") fits no rule, since rules have one. Rules without
a literal token are tried on every URL. Extra columns are not read.
"""

from __future__ import annotations

import re
import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.llm.common import store

# Rules and patterns are broadcast: more than this are refused.
MAX_RULES = 100_000
DEFAULT = "allow"
_SPLIT = r"[^0-9a-z\u0080-￿]+"

# Patterns that block by themselves: (name, expression, literal tokens).
SPAM = [
    ("cheap pills", r"(?:^|[./-])cheap-pills?(?:[./-]|$)", ["cheap"]),
    ("spam farm", r"(?:^|[./-])spam-farms?(?:[./-]|$)", ["spam"]),
    ("ad tracker", r"(?:^|[./-])ads?-track(?:er|ing)?(?:[./-]|$)", []),
    ("casino", r"(?:^|[./-])casino(?:[./-]|$)", ["casino"]),
    ("bets", r"(?:^|[./-])free-bets(?:[./-]|$)", ["free", "bets"]),
    ("adult", r"(?:^|[./-])adult(?:[./-]|$)", ["adult"]),
]


def host_of(url: Column) -> Column:
    found = F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit(""))
    return F.translate(found, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def _compiled(rules: Sequence[tuple[str, str]], patterns: Sequence[tuple]) -> list[tuple]:
    """(rank, rule, verdict, expression, tokens), best rule first."""
    if len(rules) + len(patterns) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")

    def escaped(text: str) -> str:
        return re.sub(r"([^0-9A-Za-z])", r"\\\1", text)

    out = []
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[1] != "block", r[0])):
        host, slash, path = rule.partition("/")
        if not slash:
            raise ValueError(f"a rule needs a path: {rule}")
        host = "".join(c.lower() if c.isascii() else c for c in host)  # as in URLs
        # The last piece of the path may go on in a URL, so it is no token.
        whole = re.split(_SPLIT, f"{host}/{path}".lower())[:-1]
        regex = rf"(?s)^(?:[^/]*\.)?{escaped(host)}{escaped('/' + path)}"
        out.append((len(out), rule, verdict, regex, sorted({t for t in whole if t})))
    for _, expression, literals in patterns:
        out.append((len(out), None, "block", expression, sorted(literals)))
    return out


def judge(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]],
    patterns: Sequence[tuple[str, str, Sequence[str]]] = SPAM,
    page_id: str = "page_id",
    url: str = "url",
    default: str = DEFAULT,
) -> DataFrame:
    """page_id, host, path, rule and verdict of every row.

    Only ids and URLs are read. Equal URLs are judged once; their verdicts join back on
    host and path, where adaptive execution splits a URL that many rows have.
    """
    spark = pages.sparkSession
    rows = pages.select(
        F.col(page_id).alias("page_id"),
        host_of(F.col(url)).alias("host"),
        path_of(F.col(url)).alias("path"),
    )
    compiled = _compiled(rules, patterns)
    known = spark.createDataFrame(
        compiled,
        "rank int, rule string, verdict string, expression string, literals array<string>",
    )
    sites = rows.filter("host != '' or path != ''").select("host", "path").distinct()
    whole = F.concat("host", "path")
    tokens = F.array_distinct(F.split(F.lower(whole), _SPLIT))
    found = sites.select("host", "path", F.explode(tokens).alias("token"))

    # How often the URLs hold each literal token; at most one row per token of a rule.
    wanted = known.select("rank", F.explode("literals").alias("token"))
    often = (
        found.join(F.broadcast(wanted.select("token").distinct()), "token")
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("urls"))
    )
    rarest = (
        wanted.join(often, "token", "left")
        .groupBy("rank")
        .agg(F.min(F.struct(F.coalesce("urls", F.lit(0)), "token")).alias("least"))
        .select("rank", "least.token")
    )
    index = (
        known.join(rarest, "rank", "left")
        .filter("token is not null")
        .select("rank", "token", "expression")
    )
    columns = ["host", "path", "rank", "expression"]
    candidates = found.join(F.broadcast(index), "token").select(*columns)
    if loose := [r for r in compiled if not r[4]]:  # a few rules without a literal token
        every = F.array(
            *[F.struct(F.lit(r[0]).alias("rank"), F.lit(r[3]).alias("expression")) for r in loose]
        )
        candidates = candidates.unionByName(
            sites.withColumn("every", F.explode(every)).select("host", "path", "every.*")
        )
    # Stored, so that the join exchanges both sides and can split a hot URL.
    best = store(
        candidates.filter(F.regexp_like(whole, F.col("expression")))
        .groupBy("host", "path")
        .agg(F.min("rank").alias("rank"))
        .join(F.broadcast(known.select("rank", "rule", "verdict")), "rank")
        .drop("rank")
    )
    return rows.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")
    )
