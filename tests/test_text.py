"""Worked examples of the text functions."""

import uuid

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import chunk, evaluate, evidence, graph, judge, policy, records
from lodestone.settings import Settings


def one(spark, column, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) if not isinstance(v, list) else T.literals(v).alias(k) for k, v in values.items()), "id")
    return df.select(column.alias("x")).first()["x"]


def test_windows(spark):
    docs = spark.createDataFrame([("f", "a b c d e f"), ("g", ""), ("h", None)], "source string, text string")
    rows = chunk.chunks(docs, Settings(chunk_words=3, chunk_overlap=1)).orderBy("source", "chunk_index").collect()
    assert [(r["text"], r["offset_start"], r["offset_end"]) for r in rows] == [("a b c", 0, 5), ("c d e", 5, 10), ("e f", 10, 13)]
    assert rows[0]["id"] == str(uuid.uuid5(uuid.NAMESPACE_URL, "f:0"))


def test_overlap_must_be_smaller(spark):
    try:
        chunk.chunks(spark.createDataFrame([("f", "a")], "source string, text string"), Settings(chunk_words=2, chunk_overlap=2))
    except ValueError:
        return
    raise AssertionError


def test_words_split_on_all_white_space(spark):
    text = "a b c　d\x1ce\x85f\tg\x0bh"
    assert one(spark, T.words(F.col("t")), t=text) == text.split()


def test_structured_lines(spark):
    text = "prose here\nName: Seneca\nmore prose\nrevenue, 100, usd"
    assert one(spark, T.structured_lines(F.col("t"), F.array().cast("array<string>"), 10), t=text) == ["Name: Seneca", "revenue, 100, usd", "revenue, 100, usd"]
    assert one(spark, T.structured_lines(F.col("t"), F.array(F.lit("seneca")), 10), t=text) == ["Name: Seneca"]


def test_sentences_and_clamp(spark):
    assert one(spark, T.answer_sentences(F.col("t"), 2), t="short. This is a full sentence that is long enough. also lowercase start here.") == ["This is a full sentence that is long enough."]
    twice = "This is a sentence about virtue and reason. This is a sentence about virtue and reason! Another sentence speaks of calm."
    assert one(spark, T.clamp_answer(F.col("t")), t=twice) == "This is a sentence about virtue and reason. Another sentence speaks of calm."
    assert one(spark, T.clean_answer(F.col("t")), t='{"a": 1}\nplain  line\n[x]\nprovenance: y\nend') == "plain line end"
    assert one(spark, T.technical(F.col("t")), t="") and not one(spark, T.natural(F.col("t")), t="too short")


def test_json_body(spark):
    assert one(spark, T.json_body(F.col("t")), t='said {"a": {"b": 1}} end') == '{"a": {"b": 1}}'
    assert one(spark, T.json_body(F.col("t")), t="none {here") is None


def test_claims_and_numbers(spark):
    assert one(spark, T.claims(F.col("t")), t="One. Two\nthree. . Four") == ["One", "Two three", "Four"]
    assert one(spark, T.negated(F.col("t")), t="It is NOT so") and not one(spark, T.negated(F.col("t")), t="nothing")
    assert one(spark, T.numbers(F.col("t")), t="1.5 then 1.2.3 and . 7") == [1.5, 7.0]
    assert one(spark, T.first_predicate(F.col("t")), t="It leads to this and has that") == "has"


def test_routing(spark):
    s = Settings(domain_keywords={"stoicism": ["seneca", "stoic"]})
    none = F.lit(None).cast("string")
    assert one(spark, policy.route(F.col("q"), none, none, (), s), q="what did seneca the stoic say") == "stoicism"
    assert one(spark, policy.route(F.col("q"), none, none, (), s), q="what did seneca say") is None
    assert one(spark, policy.route(F.col("q"), F.lit("Law"), none, (), s), q="seneca stoic") == "law"


def test_author_bias(spark):
    terms = F.array(F.lit("seneca"))
    for source, text, bias in (("Seneca.txt", "x", 0.8), ("x", "by Seneca", 0.4), ("x", "y", 0.0)):
        assert one(spark, evidence.author_bias(terms, F.col("s"), F.col("t")), s=source, t=text) == bias


def test_author_mentions(spark):
    assert one(spark, T.author_mentions(F.col("q"), ["seneca", "cato"]), q="Seneca and Cato on fear") == ["cato", "seneca"]
    assert one(spark, T.author_mentions(F.col("q"), ["seneca"]), q="What says Epictetus") == ["epictetus"]


def test_confidence_chain(spark):
    c = lambda base, n, k, r: round(one(spark, judge.confidence(F.lit(base), F.lit(n), F.lit(k), F.lit(r))), 6)
    assert c(0.9, 2, 0, 0) == 0.6
    assert c(0.5, 0, 0, 2) == 0.6
    assert c(0.8, 0, 1, 0) == 0.68


def test_ladders(spark):
    top = F.array(F.lit("a"), F.lit("b"))
    out = one(spark, judge.judge_ladder(F.lit('{"confidence": 0.7, "trusted_ids": ["b"]}'), F.lit(False), top))
    assert (out["confidence"], out["trusted_ids"], out["branch"]) == (0.7, ["b"], "json")
    assert one(spark, judge.judge_ladder(F.lit("no json"), F.lit(False), top))["confidence"] == 0.4
    assert one(spark, judge.judge_ladder(F.lit("x"), F.lit(True), top))["confidence"] == 0.3
    texts = F.array(F.lit("This is a sentence about virtue and reason. Another sentence speaks of calm."))
    none = F.array().cast("array<string>")
    said = one(spark, judge.synthesis_ladder(F.lit("prose"), F.lit(None).cast("string"), F.lit("ok"), texts, none, F.lit(False), F.lit(0.5)))
    assert said["explain_trace"] == "synthesis_non_json" and said["answer"].startswith("This is a sentence")


def test_evaluation(spark):
    found, wanted = T.literals(["x/a.txt", "b", "c", "d"]), T.literals(["A.txt", "d"])
    assert one(spark, evaluate.recall_at(3, found, wanted)) == 0.5
    assert one(spark, evaluate.hit_rate_at(3, found, wanted)) == 1.0
    assert one(spark, T.lexical_overlap(F.lit("the cat sat"), F.lit("the cat ran"))) == 0.5
    runs = spark.createDataFrame([("u", "q", "a", ["s"], 0.5, None), ("u", "z", None, None, None, "timeout")], "base_url string, query string, answer string, sources array<string>, confidence double, error string")
    truth = spark.createDataFrame([("q", ["s"], "")], "query string, expected_sources array<string>, reference_answer string")
    row = evaluate.score_run(runs, truth).first()
    assert (row["n"], row["errors"], row["recall"], row["lexical_overlap"]) == (2, 1, 1.0, None)
    assert "| u | 2 | 1 | 1.000 |" in evaluate.markdown(evaluate.score_run(runs, truth))


def test_policy(spark):
    rows = spark.createDataFrame([("A Bad text", "pdf", "x"), ("good", "txt", None), ("good", None, "y")], "text string, source_type string, domain string")
    keep = lambda **k: policy.apply_policy(rows, Settings(**k)).count()
    assert keep(blocklist=("bad",)) == 2
    assert keep(allowlist=("good",)) == 2
    assert keep(source_types_allow=("txt",)) == 2  # a row without a type passes
    assert keep(domains_block=("y",)) == 2
    assert keep(rules=({"action": "deny", "contains": ["good"], "domains": ["y"]},)) == 2


def test_freshness(spark):
    rows = spark.createDataFrame([(1e6,), (1e6 - 10 * 86400,), (None,)], "timestamp double")
    assert rows.where(policy.fresh(F.col("timestamp"), F.lit(5.0), 1e6)).count() == 2
    assert rows.where(policy.fresh(F.col("timestamp"), F.lit(None).cast("double"), 1e6)).count() == 3


def test_contradictions(spark):
    claims = spark.createDataFrame(
        [("c1::claim::0", "c1", "virtue alone brings lasting peace", ["virtue"]), ("c2::claim::0", "c2", "virtue alone does not brings lasting peace", ["virtue"]), ("c3::claim::0", "c3", "other words entirely here", ["other"])],
        "id string, chunk_id string, text string, entities array<string>",
    )
    assert [tuple(r) for r in graph.contradictions(claims).collect()] == [("c2::claim::0", "c1::claim::0")]
    new, old = claims.where("chunk_id = 'c2'"), claims.where("chunk_id <> 'c2'")
    assert [tuple(r) for r in graph.contradictions_with(new, old).collect()] == [("c2::claim::0", "c1::claim::0")]


def test_graph_build_and_delete(spark):
    chunks = spark.createDataFrame([("a", "Seneca is calm. Cato has doubts", "f", ["Seneca", "Cato"]), ("b", "none", "g", [])], "id string, text string, source string, entities array<string>")
    g = graph.build(chunks)
    assert g.chunk_entity.count() == 2 and g.chunk_claim.count() == 2 and g.claim_entity.count() == 2
    assert sorted(tuple(r) for r in g.relates.collect()) == [("Cato", "is", "Seneca"), ("Seneca", "is", "Cato")]
    assert graph.evidence_scores(g).first()["score"] == 2.2
    assert graph.delete_source(g, "f").chunk_claim.count() == 0
    assert graph.subgraph(g, chunks.select("id").toDF("chunk_id")).count() == 2
    assert graph.reason(g, chunks.select("id").toDF("chunk_id"))["claims"].count() == 2


def test_records(spark):
    assert records.key_tenants({"k": "t", " ": "x"}, "k, j,") == {"k": "t", "j": "j"}
    assert records.decode_cursor("1.5|7") == (1.5, 7) and records.decode_cursor("x") is None
    assert records.page_size(5000) == 1000 and records.page_size(None) == 50 and records.page_size(0) == 1
    rows = spark.createDataFrame([("ok", 100), ("ok", 30000)], "outcome string, ms int")
    got = {r["le"]: r["n"] for r in records.histogram(rows, ["outcome"], "ms", records.REQUEST_MS).collect()}
    assert got == {"100": 1, "250": 1, "500": 1, "1000": 1, "2000": 1, "5000": 1, "+Inf": 2}
    text = records.exposition({"synthesis_total": (records.counters(rows, ["outcome"]), ["outcome"], "n")})
    assert 'engine_synthesis_total{outcome="ok"} 2' in text


def test_jobs_and_cache(spark):
    events = spark.createDataFrame([("j", "ingest", "queued", 1, None), ("j", "ingest", "running", 2, None), ("j", "ingest", "failed", 3, "bad")], "job_id string, kind string, event string, ts int, error string")
    row = records.job_states(events).first()
    assert (row["status"], row["created_at"], row["finished_at"], row["error"]) == ("failed", 1, 3, "bad")
    jobs = spark.createDataFrame([(i, "succeeded", i) for i in range(5)], "job_id int, status string, created_at int")
    assert sorted(r[0] for r in records.prune_jobs(jobs, Settings(jobs_kept=3)).select("job_id").collect()) == [2, 3, 4]
    cache = records.cache_put(None, spark.createDataFrame([("k", "v")], "key string, value string"), 0.0, 10.0)
    keys = spark.createDataFrame([("k",), ("z",)], "key string")
    assert {r["key"]: r["value"] for r in records.cache_get(cache, keys, 5.0).collect()} == {"k": "v", "z": None}
    assert {r["key"]: r["value"] for r in records.cache_get(cache, keys, 20.0).collect()} == {"k": None, "z": None}


def test_feedback_oldest_wins(spark):
    audit = spark.createDataFrame([(1, "u", "q", 5.0), (2, "u", "z", 6.0)], "id int, user_id string, query string, created_at double")
    fb = spark.createDataFrame([(1, "u", "q", 5, "new", 9.0), (2, "u", "q", 4, "old", 8.0)], "id int, user_id string, query string, rating int, comment string, created_at double")
    got = {r["query"]: r["comment"] for r in records.training_rows(audit, fb, 4).collect()}
    assert got == {"q": "old", "z": None}
    assert records.training_rows(audit, fb, 4, rated_only=True).count() == 1


def test_normalize_and_provenance(spark):
    payload = "struct<text:string,source:string,timestamp:double,offset_start:int,offset_end:int,source_type:string,domain:string>"
    hits = spark.createDataFrame(
        [(1, "a", (None, "f", 1.0, 0, 9, "TXT", "D"), ("body", "s", 2.0, 3, 9, "csv", "e"), 0.5, "vector", 1)],
        f"query_id int, id string, payload {payload}, source {payload}, score double, agent string, arrival int",
    )
    row = evidence.normalize(hits).first()
    assert (row["text"], row["source"], row["offset_start"], row["source_type"]) == ("body", "f", 3, "txt")
    rows = spark.createDataFrame([(1, "a", "s", 0, 5, 1), (1, "b", "s", None, None, 2), (1, "c", "t", 1, 2, 3)], "query_id int, id string, source string, offset_start int, offset_end int, place int")
    trusted = spark.createDataFrame([(1, ["c", "a", "zz"])], "query_id int, trusted_ids array<string>")
    assert [r["id"] for r in evidence.pick(rows, trusted).orderBy("pick").collect()] == ["c", "a"]
    picks = rows.withColumn("pick", F.col("place"))
    assert [p["id"] for p in evidence.provenance(picks).first()["provenance"]] == ["a", "c"]


def test_offsets_of_real_documents(spark, tiny):
    """The same search over plain strings."""
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "source", "text")
    got = {}
    for r in chunk.chunks(docs).collect():
        got.setdefault(r["doc_id"], []).append((r["chunk_index"], r["text"], r["offset_start"], r["offset_end"]))
    for d in docs.collect():
        words, at, want = d["text"].split(), 0, []
        for i in range(0, len(words), 150):
            part = words[i : i + 200]
            found = d["text"].find(part[0], at)
            start = found if found >= 0 else at
            at = start + len(" ".join(part))
            want.append((i // 150, " ".join(part), start, at))
        assert sorted(got.get(d["doc_id"], [])) == want
