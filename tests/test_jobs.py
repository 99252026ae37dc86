"""The life cycle of jobs against the batch query, stale jobs, and the queue across failures."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import records
from lodestone.settings import Settings
from lodestone.sources.versions import Table
from lodestone.streaming import jobs

SCHEMA = "job_id string, kind string, event string, ts double, error string"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name)


def run(spark, folder, out, checkpoint, **how):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(folder))

    def put(batch, number):
        batch.withColumn("n", F.lit(number)).write.mode("append").parquet(str(out))

    jobs.life_cycle(stream, **how).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start().awaitTermination()


def last(spark, out):
    rows = {}
    for r in spark.read.parquet(str(out)).orderBy("n").collect():
        rows[r["job_id"]] = r
    return rows


def test_life_cycle_equals_the_batch_query(spark, tmp_path, rocks):
    r = random.Random(5)
    events = []
    for j in range(12):
        steps = ["queued", "running", r.choice(["succeeded", "failed"])][: r.randrange(1, 4)]
        for i, e in enumerate(steps):
            events += [(f"j{j}", "ingest", e, 1e6 + j + 10.0 * i, "bad" if e == "failed" else None)] * r.randrange(1, 3)
    r.shuffle(events)
    for i in range(0, len(events), 10):
        spark.createDataFrame(events[i : i + 10], SCHEMA).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    run(spark, tmp_path / "in", tmp_path / "out", tmp_path / "cp")
    want = {x["job_id"]: x for x in records.job_states(spark.createDataFrame(events, SCHEMA)).collect()}
    got = last(spark, tmp_path / "out")
    assert got.keys() == want.keys()
    for j, w in want.items():
        assert [got[j][c] for c in ("kind", "status", "created_s", "started_s", "finished_s", "error", "stale")] == [*(w[c] for c in ("kind", "status", "created_at", "started_at", "finished_at", "error")), False], j
    held = spark.read.format("statestore").option("path", str(tmp_path / "cp")).option("stateVarName", "job").load()
    assert {x[0] for x in held.select("key.job_id").collect()} == set(want)


def test_stale_jobs_close(spark, tmp_path, rocks):
    batches = [
        [("a", "ingest", "running", 1000.0, None), ("b", "ingest", "queued", 1000.0, None), ("c", "ingest", "succeeded", 1000.0, None)],
        [("x", "ingest", "queued", 9000.0, None)], [("x", "ingest", "running", 9001.0, None)], [("b", "ingest", "succeeded", 9002.0, None)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        run(spark, tmp_path / "in", tmp_path / "out", tmp_path / "cp", stale_s=3600.0, keep_s=100.0)  # each batch in a run of its own: state lasts
    got = last(spark, tmp_path / "out")
    assert (got["a"]["status"], got["a"]["stale"], got["a"]["error"]) == ("failed", True, "stale")
    assert (got["b"]["status"], got["b"]["stale"]) == ("succeeded", False) and got["c"]["status"] == "succeeded" and not got["x"]["stale"]


def requests(spark, *rows):
    return spark.createDataFrame([(j, s, "txt", None, 0.0, t) for j, s, t in rows], jobs.REQUEST)


def drain(folder, table, checkpoint):
    jobs.work(str(folder), table, str(checkpoint), Settings(chunk_words=3, chunk_overlap=0)).start().awaitTermination()


def state(table):
    return sorted((r["source"], r["text"]) for r in table.read().collect()), sorted(r["job_id"] for r in jobs.log(table).collect())


def test_queue(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"))
    assert jobs.log(t) is None
    jobs.enqueue(requests(spark, ("1", "a", "one two"), ("2", "b", "three"), ("2", "b", "three")), str(tmp_path / "q"))
    drain(tmp_path / "q", t, tmp_path / "cp")
    assert state(t) == ([("a", "one two"), ("b", "three")], ["1", "2"])
    jobs.enqueue(requests(spark, ("1", "a", "repeated"), ("3", "a", "newer")), str(tmp_path / "q"))
    drain(tmp_path / "q", t, tmp_path / "cp")
    assert state(t) == ([("a", "newer"), ("b", "three")], ["1", "2", "3"])
    drain(tmp_path / "q", t, tmp_path / "other")  # a new worker reads the whole queue again
    assert state(t) == ([("a", "newer"), ("b", "three")], ["1", "2", "3"])
    t.delete("b")
    t.compact()
    t.vacuum()
    assert state(t) == ([("a", "newer")], ["1", "2", "3"])


def test_worker_killed_between_write_and_commit(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"))
    jobs.enqueue(requests(spark, ("1", "a", "one")), str(tmp_path / "q"))
    publish = t._publish

    def dies(entry, txn=None):
        raise RuntimeError("killed")

    t._publish = dies
    with pytest.raises(Exception, match="killed"):
        drain(tmp_path / "q", t, tmp_path / "cp")
    t._publish = publish
    assert jobs.log(t) is None
    drain(tmp_path / "q", t, tmp_path / "cp")
    assert state(t) == ([("a", "one")], ["1"])

    def dies_after(entry, txn=None):
        publish(entry, txn)
        raise RuntimeError("killed")

    t._publish = dies_after
    jobs.enqueue(requests(spark, ("2", "b", "two")), str(tmp_path / "q"))
    with pytest.raises(Exception, match="killed"):
        drain(tmp_path / "q", t, tmp_path / "cp")
    t._publish = publish
    drain(tmp_path / "q", t, tmp_path / "cp")
    assert state(t) == ([("a", "one"), ("b", "two")], ["1", "2"]) and t.versions() == [1, 2]
