"""The table of commits: streams, repeated batches, deletion, compaction, concurrent writers."""

import threading

import pytest
from pyspark.sql import functions as F

from lodestone.settings import Settings
from lodestone.sources import files
from lodestone.sources.versions import Table
from lodestone.streaming import streams

SCHEMA = "collection string, source string, tenant string, id int, text string"


def rows(spark, *each):
    return spark.createDataFrame([("docs", s, t, i, x) for s, t, i, x in each], SCHEMA)


def seen(table, version=None):
    return sorted((r["source"] or "", r["id"], r["text"]) for r in table.read(version=version).collect())


def put_files(folder, **texts):
    folder.mkdir(parents=True)
    for name, text in texts.items():
        (folder / f"{name}.txt").write_text(text)


def run(spark, folder, table, checkpoint):
    streams.ingest(files.scan_stream(spark, str(folder)), table, str(checkpoint), Settings(chunk_words=5, chunk_overlap=0)).start().awaitTermination()


def texts(table):
    return sorted((r["source"], r["text"]) for r in table.read().collect())


def test_replace_and_delete(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"))
    with pytest.raises(ValueError):
        t.read()
    assert t.put(rows(spark, ("a", "x", 1, "one"), ("b", "x", 2, "two"), (None, None, 3, "none"))) == 1
    t.put(rows(spark, ("a", "x", 4, "again")))
    assert seen(t) == [("", 3, "none"), ("a", 4, "again"), ("b", 2, "two")]
    t.delete("b", "y")
    assert len(seen(t)) == 3
    t.delete("b", "x")
    t.delete("a")
    assert seen(t) == [("", 3, "none")]
    t.put(rows(spark, ("a", "x", 5, "back")))
    assert seen(t) == [("", 3, "none"), ("a", 5, "back")]
    assert seen(t, 2) == [("", 3, "none"), ("a", 4, "again"), ("b", 2, "two")]
    t.put(rows(spark, (None, None, 6, "null source")))
    assert seen(t) == [("", 6, "null source"), ("a", 5, "back")]


def test_append_and_upsert_by_id(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"))
    t.put(rows(spark, ("a", None, 1, "one"), ("a", None, 2, "two")))
    t.put(rows(spark, ("a", None, 2, "new"), ("a", None, 3, "three")), unit=("collection", "id"))
    assert seen(t) == [("a", 1, "one"), ("a", 2, "new"), ("a", 3, "three")]
    t.put(rows(spark, ("a", None, 9, "beside")), append=True)
    assert len(seen(t)) == 4
    t.compact()
    assert len(seen(t)) == 4
    t.put(rows(spark, ("a", None, 7, "all")))
    assert seen(t) == [("a", 7, "all")]


def test_compaction_and_vacuum(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"))
    t.put(rows(spark, ("a", None, 1, "one"), ("b", None, 2, "two")), txn=("s", 0))
    t.put(rows(spark, ("a", None, 3, "three")), txn=("s", 1))
    t.delete("b")
    t.compact()
    assert seen(t) == [("a", 3, "three")]
    assert t.vacuum(age_s=3600) > 0 and seen(t) == [("a", 3, "three")] and len(t.log()) == 1
    assert t.put(rows(spark, ("a", None, 0, "late")), txn=("s", 1)) is None  # what the stream has done outlives the entries
    t.put(rows(spark, ("b", None, 4, "four")), txn=("s", 2))
    assert seen(t) == [("a", 3, "three"), ("b", 4, "four")]


def test_compaction_keeps_what_came_meanwhile(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"))
    t.put(rows(spark, ("a", None, 1, "one"), ("b", None, 2, "two")))
    publish = t._publish

    def late(entry, txn=None):
        t._publish = publish
        t.put(rows(spark, ("a", None, 5, "meanwhile")))
        return publish(entry, txn)

    t._publish = late
    t.compact()
    assert seen(t) == [("a", 5, "meanwhile"), ("b", 2, "two")]


def test_job_that_dies_before_its_entry(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"))
    t.put(rows(spark, ("a", None, 1, "one")))
    t._write({"data": rows(spark, ("a", None, 2, "lost"))}, t.by)
    assert seen(t) == [("a", 1, "one")] and t.vacuum(age_s=3600) == 0 and t.vacuum(age_s=-10) == 2
    assert seen(t) == [("a", 1, "one")]


def test_writers_at_once(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"))
    jobs = [threading.Thread(target=lambda i=i: Table(spark, str(tmp_path / "t")).put(rows(spark, (f"s{i}", None, i, "x")))) for i in range(6)]
    [j.start() for j in jobs]
    [j.join() for j in jobs]
    assert t.versions() == list(range(1, 7)) and len(seen(t)) == 6


def test_new_columns(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"))
    t.put(rows(spark, ("a", None, 1, "one")))
    t.put(rows(spark, ("b", None, 2, "two")).selectExpr("*", "1.5D AS score"))
    assert sorted((r["id"], r["score"]) for r in t.read().collect()) == [(1, None), (2, 1.5)]


def test_streams(spark, tmp_path):
    """What lost data once: batches 0 and 1, then another checkpoint's batch 0 with a new source, then one with newer texts."""
    t = Table(spark, str(tmp_path / "table"))
    put_files(tmp_path / "one" / "x" / "law", a="first a", b="first b")
    run(spark, tmp_path / "one", t, tmp_path / "cp1")
    put_files(tmp_path / "one" / "y" / "law", b="second b")
    run(spark, tmp_path / "one", t, tmp_path / "cp1")
    assert texts(t) == [("a.txt", "first a"), ("b.txt", "second b")]
    put_files(tmp_path / "two" / "law", c="new c")
    run(spark, tmp_path / "two", t, tmp_path / "cp2")
    assert texts(t) == [("a.txt", "first a"), ("b.txt", "second b"), ("c.txt", "new c")]
    put_files(tmp_path / "three" / "law", a="newer a")
    run(spark, tmp_path / "three", t, tmp_path / "cp3")
    assert texts(t) == [("a.txt", "newer a"), ("b.txt", "second b"), ("c.txt", "new c")]
    t.delete("b.txt")
    assert texts(t) == [("a.txt", "newer a"), ("c.txt", "new c")]


def test_repeated_batch(spark, tmp_path):
    t = Table(spark, str(tmp_path / "table"))
    put_files(tmp_path / "in", a="text of a")
    run(spark, tmp_path / "in", t, tmp_path / "cp")
    (tmp_path / "cp" / "commits" / "0").unlink()  # as if the driver had died before the stream's own record
    for crc in (tmp_path / "cp" / "commits").glob(".0.crc"):
        crc.unlink()
    with pytest.raises(ValueError):
        t.put(rows(spark, ("a.txt", None, 1, "number instead of a text")))
    t.put(rows(spark, ("a.txt", None, 1, "newer")).withColumn("id", F.lit("x")))
    run(spark, tmp_path / "in", t, tmp_path / "cp")
    assert texts(t) == [("a.txt", "newer")]  # not put back by the repeated batch
    assert len(t.versions()) == 2


def test_two_streams_at_once(spark, tmp_path):
    t = Table(spark, str(tmp_path / "table"))
    for k in range(2):
        put_files(tmp_path / f"in{k}", **{f"f{k}": f"text {k}"})
    make = lambda k: streams.ingest(files.scan_stream(spark, str(tmp_path / f"in{k}")), t, str(tmp_path / f"cp{k}"), Settings(chunk_words=5, chunk_overlap=0)).start()
    for q in [make(0), make(1)]:
        q.awaitTermination()
    assert texts(t) == [("f0.txt", "text 0"), ("f1.txt", "text 1")]
