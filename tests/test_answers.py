"""Answers with a time to live: hits, expiry, asking again, and a stream that starts again."""

import pytest
from pyspark.sql import functions as F

from lodestone.plans.engine import Engine
from lodestone.settings import Settings
from lodestone.sources.answers import AnswerCache
from lodestone.sources.versions import Table
from lodestone.streaming.streams import serve


class Loud(Engine):
    """Answers by shouting; tells what it was asked. A plan without an action asks nothing."""

    asked: list
    kind = "answer string, provenance array<struct<id:string,source:string>>, confidence double"

    def answer(self, corpus, questions, graph=None):
        self.asked.append(sorted(r["query"].strip().lower() for r in questions.select("query").collect()))
        found = F.array(F.struct(F.col("query").alias("id"), F.lit(None).cast("string").alias("source")))
        return questions.select("query_id", "query", F.upper(F.trim("query")).alias("answer"), found.alias("provenance"), F.lit(0.25).alias("confidence"))


@pytest.fixture()
def engine():
    made = Loud()
    made.asked = []
    return made


def ask(spark, engine, cache, now, *rows):
    q = spark.createDataFrame(list(rows), "query_id int, query string, preferences struct<domain:string>")
    return {r["query_id"]: r for r in engine.answer_cached(None, q, cache, now).collect()}


def test_clock(spark, engine, tmp_path):
    cache = AnswerCache(spark, f"file://{tmp_path}/c", 300.0)
    got = ask(spark, engine, cache, 1000.0, (1, "Owls", None), (2, "  owls ", None), (3, "hawks", None), (4, "owls", ("birds",)))
    assert {r["cache"] for r in got.values()} == {"miss"} and got[2]["answer"] == "OWLS" and got[2]["query"] == "  owls "
    assert engine.asked == [["hawks", "owls", "owls"]]  # equal ones once; other wishes are another question
    got = ask(spark, engine, cache, 1299.0, (9, "OWLS", None), (8, "mice", None))
    assert (got[9]["cache"], got[8]["cache"]) == ("hit", "miss") and got[9]["confidence"] == 0.25 and got[9]["provenance"][0]["source"] is None
    assert engine.asked[1] == ["mice"]
    assert ask(spark, engine, cache, 1300.0, (9, "owls", None))[9]["cache"] == "miss"  # expired to the second
    assert ask(spark, engine, cache, 1590.0, (9, "owls", None), (8, "mice", None))[9]["cache"] == "hit"  # since 1300
    other = Loud(Settings(blocklist=("x",)))
    other.asked = []
    assert ask(spark, other, cache, 1590.0, (9, "owls", None))[9]["cache"] == "miss"  # another policy
    cache.evict(1595.0, 0.0)
    assert cache.table.read().where("expires_at <= 1595").count() == 0
    assert ask(spark, engine, cache, 1596.0, (9, "owls", None))[9]["cache"] == "hit"
    assert ask(spark, engine, cache, 1596.0) == {}


def test_stream(spark, engine, tmp_path):
    cache, out, now = AnswerCache(spark, f"file://{tmp_path}/c", 300.0), Table(spark, f"file://{tmp_path}/out", ("query_id",), {}), [1000.0]
    queue = f"{tmp_path}/queue"

    def put(*rows):
        spark.createDataFrame(list(rows), "query_id int, query string").coalesce(1).write.mode("append").json(queue)

    def run(checkpoint="cp"):
        stream = spark.readStream.schema("query_id int, query string").json(queue)
        serve(stream, engine, None, cache, out, f"{tmp_path}/{checkpoint}", lambda: now[0]).start().awaitTermination()
        return {r["query_id"]: r["cache"] for r in out.read().collect()}

    put((1, "owls"), (1, "owls"), (2, "hawks"))
    assert run() == {1: "miss", 2: "miss"}
    assert run() == {1: "miss", 2: "miss"} and len(engine.asked) == 1
    now[0] = 1200.0
    put((3, "owls"))
    assert run()[3] == "hit"
    now[0] = 1400.0
    put((4, "Owls "))
    assert run() == {1: "miss", 2: "miss", 3: "hit", 4: "miss"}
    assert set(run("again").values()) >= {"hit"}  # another stream asks all again
    assert out.read().count() == 4
