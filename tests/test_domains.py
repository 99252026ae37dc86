"""Search by domain: which index a question reaches, what is read, and what comes again."""

import math

import pytest
from pyspark.sql import functions as F

from lodestone.operators import domains
from lodestone.settings import Settings

DOCS = [
    (1, "owls hunt at night", "a.txt", "docs_index_birds"), (2, "owls and hawks", "b.txt", "docs_index_birds"), (3, "owls of the base", "c.txt", None),
    (4, "iron owls", "a.txt", "docs_index_tools"), (5, None, "d.txt", "docs_index_tools"), (6, "", None, "docs_index_birds"), (7, "owls hunt at night", "e.txt", "docs_index_birds"),
]
KIND = "id long, text string, source string, index string"


@pytest.fixture()
def held(spark, tmp_path):
    made = domains.DomainLexicon(spark, f"file://{tmp_path}/lex")
    made.add(spark.createDataFrame(DOCS, KIND))
    return made


def ask(held, spark, rows, settings=Settings()):
    subs = domains.fan_out(spark.createDataFrame(rows, "query_id int, query string, domain string"), settings).withColumn("query_id", F.struct("query_id", "domain_idx"))
    got = {}
    for r in held.search(subs).orderBy("rank").collect():
        got.setdefault(tuple(r["query_id"]), []).append((r["id"], r["score"]))
    return got


def test_indexes(held, spark):
    got = ask(held, spark, [(1, "owls", "Birds"), (2, "owls", None), (3, "owls", "nowhere"), (4, "owls", "mapped"), (5, " ", "birds"), (6, None, "birds"), (7, "hawks", "tools")], Settings(domain_index_map={"mapped": "docs_index_tools"}))
    ids = {k: [i for i, _ in v] for k, v in got.items()}
    assert ids == {(1, 0): [2, 1, 7], (2, 0): [3], (3, 0): [3], (4, 0): [4]}  # of equal texts the smaller id first
    birds = dict(got[1, 0])
    mean, idf = (4 + 3 + 0 + 4) / 4, math.log(1 + (4 - 3 + 0.5) / 3.5)
    assert birds[2] == pytest.approx(idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 3 / mean)), abs=1e-8)  # by the index's own statistics


def test_fallbacks(held, spark):
    s = Settings(domain_fallbacks=("tools", "birds", ""))
    got = ask(held, spark, [(1, "owls", "birds"), (2, "owls", None)], s)
    assert {k: [i for i, _ in v] for k, v in got.items()} == {(1, 0): [2, 1, 7], (1, 1): [4], (2, 0): [4], (2, 1): [2, 1, 7]}
    assert {r[0] for r in held.domains().collect()} == {"birds", "tools"}


def test_tenants(spark):
    q = spark.createDataFrame([(1, None, "t1"), (2, "d", "t1"), (3, None, None)], "query_id int, domain string, tenant string")
    assert {r["query_id"]: r["index"] for r in domains.fan_out(q).collect()} == {1: "docs_index_t1", 2: "docs_index_d", 3: "docs_index"}


def test_replaced_in_one_index(held, spark):
    held.add(spark.createDataFrame([(8, "no birds here", "a.txt", "docs_index_birds")], KIND))
    got = ask(held, spark, [(1, "owls", "birds"), (2, "owls", "tools")])
    assert {k: [i for i, _ in v] for k, v in got.items()} == {(1, 0): [2, 7], (2, 0): [4]}
    held.delete("b.txt")
    assert [i for i, _ in ask(held, spark, [(1, "owls", "birds")])[1, 0]] == [7]


def test_reads_the_asked_indexes(held, spark):
    subs = domains.fan_out(spark.createDataFrame([(1, "owls hunt", "birds")], "query_id int, query string, domain string"))
    plan = held.search(subs)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan


def test_empty(spark, tmp_path, held):
    none = spark.createDataFrame([], "query_id int, query string, domain string")
    assert held.search(domains.fan_out(none)).count() == 0
    empty = domains.DomainLexicon(spark, f"file://{tmp_path}/none")
    empty.add(spark.createDataFrame([], KIND))
    assert empty.search(domains.fan_out(spark.createDataFrame([(1, "x", "y")], "query_id int, query string, domain string"))).count() == 0
