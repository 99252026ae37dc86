"""Graph contexts of many questions: each equals the reasoner's for that question alone."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import context, graph
from lodestone.operators.graph import Graph
from lodestone.plans.engine import Engine
from lodestone.settings import Settings


@pytest.fixture(scope="module")
def g(spark):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    return Graph(
        make([(f"c{i}", f"E{j}") for i in range(8) for j in range(4) if (i * j) % 3 != 1], "chunk_id string, name string"),
        make([(f"c{i}", f"k{(i * 3 + j) % 7}") for i in range(8) for j in range(3)], "chunk_id string, claim_id string"),
        make([(f"k{i}", f"E{i % 4}") for i in range(7)], "claim_id string, name string"),
        make([("E0", "owns", "E1"), ("E0", "sells", "E1"), ("E1", "has", "E2"), ("E3", "is", "E0")], "src string, predicate string, dst string"),
        make([("k1", "k2"), ("k3", "k1")], "a string, b string"),
    )


ASKED = {1: ["c0", "c1", "c2"], 2: ["c5"], 3: ["nosuch"], 4: [f"c{i}" for i in range(8)]}


def test_each_question_as_if_alone(spark, g):
    s = Settings(graph_top=4)
    asked = spark.createDataFrame([(q, c) for q, cs in ASKED.items() for c in cs + cs[:1]] + [(5, None)], "query_id int, chunk_id string")
    parts = context.contexts(g, asked, settings=s)
    shared = {"claims": ("claim_id", "support_count", "contradict_count"), "entity_density": ("name", "chunks"), "relations": ("src", "predicate", "dst", "n"), "relation_strength": ("src", "predicate", "dst", "strength"), "evidence_scores": ("chunk_id", "score"), "paths": ("chunk_id", "src", "dst", "n")}
    for q, cs in ASKED.items():
        alone = graph.reason(g, spark.createDataFrame([(c,) for c in cs], "chunk_id string"), s)
        for name, columns in shared.items():
            rows = lambda df: sorted(tuple(r) for r in df.select(*columns).collect())
            assert rows(parts[name].where(F.col("query_id") == q)) == rows(alone[name]), (q, name)
    assert {r["query_id"] for r in parts["relation_conflicts"].collect()} >= {1, 4}
    assert all(r["contradict_count"] > 0 for r in context.contradicted(parts).collect())


def test_of_results(spark, g):
    hits = spark.createDataFrame([(1, "c0", "Here Plato speaks"), (2, None, None)], "query_id int, id string, text string")
    parts = context.of_results(Graph(spark.createDataFrame([("c9", "Plato"), ("c0", "E0")], "chunk_id string, name string"), g.chunk_claim, g.claim_entity, g.relates, g.contradicts), hits)
    assert [tuple(r) for r in parts["signals"].select("query_id", "name", "chunks").collect()] == [(1, "Plato", 1)]


def test_confidence_follows_the_graph(spark):
    docs = spark.createDataFrame([("Rome owns Carthage and the sea", "a"), ("Rome owns Carthage and the land", "b"), ("Egypt is far away", "c")], "text string, source string").withColumns({"source_type": F.lit("txt"), "domain": F.lit(None).cast("string"), "timestamp": F.lit(0.0)})
    engine = Engine()
    chunks = engine.ingest(docs)
    ids = {r["source"]: r["id"] for r in chunks.collect()}
    edges = [(ids["a"], "Rome"), (ids["b"], "Rome"), (ids["a"], "Carthage")]
    one = spark.createDataFrame([(ids["a"], "k")], "chunk_id string, claim_id string")
    g = Graph(spark.createDataFrame(edges, "chunk_id string, name string"), one, spark.createDataFrame([("k", "Rome")], "claim_id string, name string"), spark.createDataFrame([("Rome", "owns", "Carthage")], "src string, predicate string, dst string"), spark.createDataFrame([], "a string, b string"))
    q = spark.createDataFrame([(1, "who owns Carthage"), (2, "Egypt")], "query_id int, query string")
    got = {r["query_id"]: r["confidence"] for r in engine.answer(chunks, q, g).collect()}
    assert got[1] == pytest.approx(0.45) and got[2] == pytest.approx(0.4)
    against = Graph(g.chunk_entity, g.chunk_claim, g.claim_entity, g.relates, spark.createDataFrame([("k", "z")], "a string, b string"))
    assert {r["query_id"]: r["confidence"] for r in engine.answer(chunks, q, against).collect()}[1] < 0.45
