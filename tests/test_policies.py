"""Policies that come with the questions give what one compiled for their settings gives."""

import itertools

import pytest
from pyspark.sql import functions as F

from lodestone.operators import policy
from lodestone.settings import Settings

ROW = "id int, text string, source_type string, domain string, timestamp double"
DAY = 86400.0


@pytest.fixture(scope="module")
def rows(spark):
    texts = [None, "", "Plain words", "a bad word", "Good and BAD", "good"]
    each = itertools.product(texts, [None, "", "PDF", "txt"], [None, "En", "fr"])
    return spark.createDataFrame([(i, *r, None if i % 3 == 0 else i * DAY) for i, r in enumerate(each)], ROW)


RULES = (
    {"action": "none", "contains": ["good"]},
    {"action": "Allow", "domains": ["en"], "contains": ["good"]},
    {"action": "deny", "source_types": ["pdf"], "not_contains": ["plain"]},
)
CASES = [
    Settings(),
    Settings(blocklist=("Bad",), freshness_days=20.0),
    Settings(allowlist=("good", "plain"), domains_block=("fr",)),
    Settings(source_types_allow=("PDF",), domains_allow=("en",)),
    Settings(source_types_block=("pdf",), rules=RULES[:2]),
    Settings(rules=RULES),
]


def test_like_compiled(spark, rows):
    wanted, parts = set(), []
    for n, s in enumerate(CASES):
        kept = policy.apply_policy(rows, s).where(policy.fresh(F.col("timestamp"), F.lit(s.freshness_days).cast("double"), 70 * DAY))
        wanted |= {(n, r["id"]) for r in kept.select("id").collect()}
        parts.append(policy.united(spark.createDataFrame([(n,)], "query_id int"), s))
    policies = parts[0]
    for p in parts[1:]:
        policies = policies.union(p)
    asked = rows.crossJoin(spark.range(len(CASES)).select(F.col("id").cast("int").alias("query_id")))  # a fixture of a few rows
    got = policy.apply_by_question(asked, policies, 70 * DAY)
    assert {(r["query_id"], r["id"]) for r in got.collect()} == wanted


def test_union_and_precedence(spark):
    kind = "query_id int, constraints struct<blocklist:string,domains_allow:array<string>,freshness_days:int,freshness:int>, preferences struct<blocklist:array<string>,freshness_days:int>"
    q = spark.createDataFrame([
        (1, (" B, ,c", ["X", None, " "], 0, 9), (["D"], None)), (2, (None, None, 3, 9), (None, 0)), (3, None, None), (4, ("", [], None, None), ([], 5)),
    ], kind)
    got = {r["query_id"]: r["policy"] for r in policy.united(q, Settings(blocklist=("A",), freshness_days=30.0)).collect()}
    assert got[1]["blocklist"] == ["a", "b", "c", "d"] and got[1]["domains_allow"] == ["x"]
    assert [got[i]["freshness_days"] for i in (1, 2, 3, 4)] == [9.0, 0.0, 30.0, 5.0]
    assert got[3]["blocklist"] == got[4]["blocklist"] == ["a"] and got[3]["rules"] == []


def test_signatures(spark):
    q = spark.createDataFrame([(1, ("a",)), (2, ("A ",)), (3, ("b",)), (4, None)], "query_id int, constraints struct<blocklist:string>")
    got = {r[0]: r[1] for r in policy.united(q).select("query_id", policy.signature_of(F.col("policy"))).collect()}
    assert got[1] == got[2] and len({got[1], got[3], got[4]}) == 3 and all(len(v) == 16 for v in got.values())


def test_no_rows(spark, rows):
    none = policy.united(spark.createDataFrame([], "query_id int"))
    asked = rows.withColumn("query_id", F.lit(1))
    assert policy.apply_by_question(asked, none, 0.0).count() == rows.count()  # no policy: all stay
    assert policy.apply_by_question(asked.limit(0), none, 0.0).count() == 0
