"""A judge and a writer plugged into the engine: each rung of their ladders, and what is said of it."""

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.functions.models import model_column
from lodestone.plans.engine import ANSWER, Engine

LONG = "Owls hunt mice at night because their eyes and ears are made for it."


def verdict(queries):
    said = {"json": '{"confidence": 0.9, "trusted_ids": ["%s", "none"], "notes": "fine"}', "prose": "I can't say", "broken": None}
    return [next((v for k, v in said.items() if k in q), None) for q in queries]


def test_ladders(spark):
    docs = spark.createDataFrame([("owls and json, prose, broken, late: owls sleep all day in old barns.", "a.txt"), (f"owls {LONG}", "b.txt")], "text string, source string")
    docs = docs.withColumns({"source_type": F.lit("txt"), "domain": F.lit(None).cast("string"), "timestamp": F.lit(0.0)})
    chunks = Engine().ingest(docs)
    second = {r["source"]: r["id"] for r in chunks.select("id", "source").collect()}["b.txt"]
    model = model_column(lambda: verdict, "string")
    judge = lambda q, rows: F.replace(model(q), F.lit("%s"), F.lit(second))
    good = F.lit('{"answer": "%s", "confidence": 0.8, "explain_trace": "read"}' % LONG)
    write = lambda q, rows: F.struct(F.when(F.contains(q, F.lit("late")), "timeout").otherwise("ok").alias("status"), F.when(F.contains(q, F.lit("json")), good).otherwise("no").alias("response"), F.lit(None).cast("string").alias("naturalized"))
    q = spark.createDataFrame([(1, "owls json"), (2, "owls prose"), (3, "owls broken late"), (4, "zebra")], "query_id int, query string")
    answers = Engine(judge=judge, write=write).answer(chunks, q)
    got = {r["query_id"]: r for r in answers.collect()}
    assert [p["source"] for p in got[1]["provenance"]] == ["b.txt"] and got[1]["answer"] == LONG and got[1]["confidence"] == 0.8 and got[1]["notes"] == "fine"
    assert got[2]["confidence"] == 0.4 and got[2]["notes"] == "judge_non_json" and got[2]["explain_trace"] == "synthesis_non_json" and len(got[2]["provenance"]) == 2
    assert got[3]["confidence"] == 0.3 and "synthesis_timeout" in got[3]["retrieval_failures"] and got[3]["explain_trace"] == "synthesis_timeout"
    assert "no_results" in got[4]["retrieval_failures"] and got[4]["provenance"] == []
    kinds = {f.name: f.dataType.simpleString() for f in answers.schema.fields}
    assert {k: v for k, v in kinds.items() if k not in ("query_id", "query")} == {f.name: f.dataType.simpleString() for f in StructType.fromDDL(ANSWER).fields}
