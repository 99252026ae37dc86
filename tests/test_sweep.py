"""Configurations in one plan: the rows are those of single runs; questions with wishes and domains go the same way."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import evaluate, sweep
from lodestone.plans.engine import Engine
from lodestone.settings import Settings

DOCS = [
    ("At night owls hunt mice in the fields around the old farm.", "a.txt", "birds"), ("owls sleep by day", "b.txt", "birds"), ("hawks hunt by day", "c.txt", "birds"),
    ("hammers and owls of iron", "d.txt", "tools"), ("night tools: lamps", "e.txt", "tools"), ("owls in the base", "f.txt", None),
]


@pytest.fixture(scope="module")
def chunks(spark):
    docs = spark.createDataFrame(DOCS, "text string, source string, domain string").withColumns({"source_type": F.lit("txt"), "timestamp": F.lit(0.0)})
    return Engine().ingest(docs)


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(1, "where do owls hunt"), (2, "night"), (3, " ")], "query_id int, query string")


def plain(rows):
    return sorted((r.asDict(recursive=True) for r in rows), key=repr)


def test_like_single_runs(spark, chunks, asked, tmp_path):
    configs = {"wide": Settings(), "narrow": Settings(top_k=2, rerank_top_k=1, blocklist=("mice",), judge_non_json=0.7, min_results=1, min_top_score=5.0)}
    path = f"{tmp_path}/runs"
    sweep.write(Engine().ablate(chunks, asked, configs), path)
    got = spark.read.json(path)
    keys = ["query_id", "answer", "confidence", "hallucination_risk", "retrieval_failures", "sources"]
    s = configs["narrow"]
    single = Engine(s).answer(chunks, asked.where("query_id < 3")).withColumn("sources", F.transform("results", lambda r: r["source"]))
    assert plain(got.where("base_url = 'narrow' AND error IS NULL").select(*keys).collect()) == plain(single.select(*keys).collect())
    assert got.where("base_url = 'wide' AND query_id = 1").first()["sources"] != got.where("base_url = 'narrow' AND query_id = 1").first()["sources"]
    bad = got.where("error IS NOT NULL").select("base_url", "query_id").collect()
    assert sorted(map(tuple, bad)) == [("narrow", 3), ("wide", 3)]
    truth = spark.createDataFrame([("night", ["a.txt"], "")], "query string, expected_sources array<string>, reference_answer string")
    scores = {r["config"]: r for r in evaluate.score_run(got, truth).collect()}
    assert scores["wide"]["n"] == 3 and scores["wide"]["errors"] == 1 and scores["wide"]["recall"] == 1.0 and scores["narrow"]["recall"] == 0.0
    assert 0 < scores["wide"]["faithfulness"] <= 1
    with pytest.raises(ValueError, match="chunk_words"):
        sweep.spread(asked, {"a": Settings(), "b": Settings(chunk_words=9)})


def test_wishes_and_domains(spark, chunks):
    kind = "query_id int, query string, constraints struct<domain:string,blocklist:string>"
    q = spark.createDataFrame([(1, "owls", ("Birds", "mice")), (2, "owls", ("tools", None)), (3, "owls", None), (4, "owls", (None, "owls"))], kind)
    rows = Engine(Settings(domain_collections=True)).answer(chunks, q).select("query_id", "domain_source", "retrieval_failures", F.sort_array(F.transform("results", lambda r: r["source"])).alias("s")).collect()
    got = {r["query_id"]: r for r in rows}
    assert {k: r["s"] for k, r in got.items()} == {1: ["b.txt"], 2: ["d.txt"], 3: ["f.txt"], 4: []}
    assert got[1]["domain_source"] == "constraint" and "policy_blocked" in got[4]["retrieval_failures"] and "policy_blocked" not in got[1]["retrieval_failures"]
