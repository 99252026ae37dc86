"""Searches whose exchanges don't grow with questions times documents: what the plans hold, and results over several cells and groups."""

import random

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import blocks, retrieve
from lodestone.operators.lexicon import Lexicon
from tests.test_lexicon import QUESTIONS, corpus, frame, got, plain
from tests.test_vectors import plain as plain_vectors


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_vectors_in_cells(spark, monkeypatch):
    r = random.Random(9)
    rows = [(i, "s", [r.gauss(0, 1) for _ in range(4)]) for i in range(60)]
    rows += [(90, "s", [0.0] * 4), (91, "s", None), (92, "s", rows[0][2])]
    v = spark.createDataFrame(rows, "id long, source string, embedding array<double>")
    monkeypatch.setattr(retrieve, "CELL_VECTORS", 20)
    monkeypatch.setattr(retrieve, "CELL_QUERIES", 4)
    found = retrieve.vector(v, v.where("id % 6 = 0").select(F.col("id").alias("query_id"), "embedding"), 5)
    assert "Join" not in plan(found)  # no pair of a question and a vector is a row
    want = sorted(plain_vectors(rows, [(i, x) for i, _, x in rows if i % 6 == 0 and x and any(x)], 5))
    assert sorted((x["query_id"], x["rank"], x["id"], round(x["score"], 6)) for x in found.collect()) == want


def test_questions_share_postings(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(blocks, "TOGETHER", 50)
    docs = corpus(11)
    x = Lexicon(spark, str(tmp_path / "x"))
    x.add(frame(spark, docs))
    found = x.search(spark.createDataFrame(QUESTIONS, "query_id int, query string"), 5)
    assert "FlatMapCoGroupsInArrow" in plan(found)  # postings are sent once, not for each question
    assert got(found) == plain(docs, QUESTIONS, 5)


def test_once(spark):
    calls = spark.range(1).select(T.once(F.col("id") + 1, lambda v: v * v + v).alias("x"))
    assert calls.first()["x"] == 2
