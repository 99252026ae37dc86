"""Files, packs, stores and streams."""

import json

from lodestone.settings import Settings
from lodestone.sources import files, store
from lodestone.streaming import streams


def test_flatten():
    assert files.flatten('{"a": {"b": 1}, "c": [2, true], "e": {}}', "json") == "a.b: 1\nc.0: 2\nc.1: True"
    assert files.flatten("h1,h2\n1,2,x\n3", "csv") == "h1: 1 | h2: 2 | col_2: x\nh1: 3"
    assert files.flatten("{bad", "json") == "{bad" and files.flatten("", "csv") == ""


def corpus(folder):
    (folder / "Law").mkdir(parents=True)
    (folder / "root.TXT").write_text("top words here", encoding="utf-8")
    (folder / "Law" / "a.json").write_text(json.dumps({"k": "v"}), encoding="utf-8")
    (folder / "Law" / "b.csv").write_text("x,y\n1,2\n", encoding="utf-8")
    (folder / "Law" / "skip.md").write_text("no", encoding="utf-8")
    return str(folder)


def test_scan(spark, tmp_path):
    rows = {r["source"]: r for r in files.scan(spark, corpus(tmp_path / "c")).collect()}
    assert set(rows) == {"root.TXT", "a.json", "b.csv"}
    assert rows["root.TXT"]["domain"] is None and rows["a.json"]["domain"] == "law"
    assert rows["a.json"]["text"] == "k: v" and rows["b.csv"]["text"] == "x: 1 | y: 2" and rows["root.TXT"]["source_type"] == "txt"


def test_packs(spark, tmp_path):
    (tmp_path / "p").mkdir()
    pack = {"name": "n", "authors": ["Seneca"], "author_stopwords": ["Stoic", "stoic"], "term_synonyms": {"fear": ["dread", "dread"]}, "planner_hints": [{"triggers": ["fear"], "intent": "i", "queries": ["q"]}, {"triggers": []}]}
    (tmp_path / "p" / "a.json").write_text(json.dumps(pack, indent=1))
    found = files.packs(spark, str(tmp_path / "p"))
    assert files.pack_set(found, "author_stopwords") == ["stoic"] and files.synonyms(found, {"fear": ["awe"]}) == {"fear": ["dread", "awe"]}
    assert len(files.planner_rules(found)) == 1
    assert files.packs(spark, str(tmp_path / "missing")) == []


def test_evaluation_files(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"query": "q", "reference_answer": "a"}\n\n{"x": 1}\n{"query": "q", "expected_sources": ["s"]}\n')
    rows = [tuple(r) for r in files.ground_truth(spark, str(tmp_path / "t.jsonl")).collect()]
    assert rows == [("q", ["s"], "")]
    (tmp_path / "q.txt").write_text('plain question\n{"query": "from json"}\n{broken\n')
    assert sorted(r[0] for r in files.questions(spark, str(tmp_path / "q.txt")).collect()) == ["from json", "plain question", "{broken"]


def test_author_terms(spark):
    chunks = spark.createDataFrame([("Seneca_letters.txt",), ("other.txt",)], "source string")
    assert [tuple(r) for r in files.author_terms(chunks, {"d": ["seneca"]}).collect()] == [("seneca", ["Seneca_letters.txt"])]


def test_store(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "t", None), (2, "b", "t", "d"), (3, "b", None, None)], "id int, source string, tenant string, domain string")
    named = store.namespaced(rows)
    assert [r["collection"] for r in named.orderBy("id").collect()] == ["docs_t", "docs_d", "docs"]
    new = named.where("id = 2").withColumn("id", named["id"] + 10)
    assert sorted(r["id"] for r in store.replace_sources(named, new).collect()) == [1, 3, 12]
    assert store.delete_source(named, "b").count() == 1 and store.delete_source(named, "b", "t").count() == 2
    store.write_chunks(named, str(tmp_path / "t"))
    assert store.read_collection(spark, str(tmp_path / "t"), "d", None).count() == 1
    assert store.read_collection(spark, str(tmp_path / "t"), "nosuch", None).count() == 1
    assert [r[0] for r in store.domains(named).orderBy("domain").collect()] == ["d", "t"]


def test_export(spark, tmp_path):
    rows = spark.createDataFrame([(i, float(i)) for i in range(5)], "id int, created_at double")
    assert store.export_jsonl(rows, str(tmp_path / "x"), 3) == 3


def test_rate_stream_matches_batch(spark, tiny):
    events = spark.read.parquet(f"{tiny}/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet(f"{tiny}/events*.parquet")
    q = streams.request_windows(stream).writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = streams.request_windows(events)
    assert sorted(map(tuple, spark.table("rates").collect())) == sorted(map(tuple, batch.collect()))


def test_answer_events(spark):
    answers = spark.createDataFrame([(1, "two words", "[]", 0.4)], "query_id int, answer string, provenance string, confidence double")
    rows = streams.answer_events(answers).orderBy("seq").collect()
    assert [r["event"] for r in rows] == ["meta", "token", "token", "final", "done"] and "".join(r["data"] for r in rows if r["event"] == "token") == "two words"


