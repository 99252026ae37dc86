"""The stored index: against plain scores, both ways of searching, changes by source, what it reads."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.operators import lexicon
from lodestone.operators.lexicon import Lexicon


def plain(docs, questions, k):
    words = {i: re.findall(r"[^\W_]+", (t or "").lower()) for i, t, _ in docs}
    n, mean = len(docs), sum(map(len, words.values())) / max(1, len(docs)) or 1.0
    tf = {i: Counter(w) for i, w in words.items()}
    df = Counter(w for c in tf.values() for w in c)
    out = []
    for q, text in questions:
        asked = set(re.findall(r"[^\W_]+", text.lower()))
        scores = {}
        for i, c in tf.items():
            if asked & c.keys():
                scores[i] = round(sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * len(words[i]) / mean)) for w in asked if c[w]), 6)
        best = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]
        out += [(q, i, r + 1, s) for r, (i, s) in enumerate(best)]
    return sorted(out)


def corpus(seed, n=400):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    return [(i, " ".join(r.choices(vocab, [1 / (j + 1) for j in range(60)], k=r.randrange(0, 40))) or None, r.choice(["a", "b", "c", None])) for i in range(n)]


def frame(spark, docs):
    return spark.createDataFrame(docs, "id long, text string, source string")


def got(rows):
    return sorted((r["query_id"], r["id"], r["rank"], round(r["score"], 6)) for r in rows.collect())


QUESTIONS = [(1, "w0 w3 w40"), (2, "W59 w58 w57 w0 w1 w2"), (3, "nothing known"), (4, ""), (5, "w1 w1 w1"), (6, " ".join(f"w{i}" for i in range(60)))]


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame(QUESTIONS, "query_id int, query string")


def test_search_both_ways(spark, asked, tmp_path, monkeypatch):
    monkeypatch.setattr(lexicon, "BLOCK", 8)
    docs = corpus(1)
    x = Lexicon(spark, str(tmp_path / "x"))
    x.add(frame(spark, docs))
    for k in (1, 5, 500):
        want = plain(docs, QUESTIONS, k)
        assert got(x.search(asked, k)) == want
        assert got(x.search(asked, k, whole=0)) == want
    monkeypatch.setattr(lexicon, "BROADCAST_TERMS", 3)
    assert got(x.search(asked, 5, whole=0)) == plain(docs, QUESTIONS, 5)


def test_source_that_comes_again(spark, asked, tmp_path):
    docs = corpus(2)
    x = Lexicon(spark, str(tmp_path / "x"))
    x.add(frame(spark, docs))
    files = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "x" / "postings").rglob("*.parquet")}
    before = files()
    new = [(1000 + i, t, "a") for i, t, _ in corpus(3, 60)]
    x.add(frame(spark, new))
    x.delete("b")
    after = files()
    assert before.items() <= after.items()  # other sources' blocks are as they were
    assert {r[0] for r in spark.read.parquet(*map(str, after.keys() - before.keys())).select("source").distinct().collect()} == {"a"}
    alive = [(i, t, s) for i, t, s in docs if s not in ("a", "b")] + new
    assert got(x.search(asked, 6)) == got(x.search(asked, 6, whole=0)) == plain(alive, QUESTIONS, 6)
    x.table.compact()
    assert x.table.vacuum() > 0 and got(x.search(asked, 6)) == plain(alive, QUESTIONS, 6)


def test_reads_only_the_folders_asked(spark, tmp_path):
    x = Lexicon(spark, str(tmp_path / "x"))
    x.add(frame(spark, corpus(4)))
    q = spark.createDataFrame([(1, "w7 w9")], "query_id int, query string")
    folders = {r[0] for r in spark.createDataFrame([("w7",), ("w9",)], "t string").select(lexicon.bucket(F.col("t"))).collect()}
    for whole in (lexicon.WHOLE, 0):
        plan = x.search(q, 3, whole)._jdf.queryExecution().toString()
        scans = re.findall(r"PartitionFilters: \[[^\]]*bucket[^\]]*\]+", plan)
        assert scans and all({int(n) for n in re.findall(r"IN \(([\d,]+)\)|= (\d+)", s)[0][0].split(",") if n} <= folders for s in scans if " IN " in s)


def test_authors(spark, tmp_path):
    docs = [(1, "stoic calm mind", "Seneca_letters"), (2, "calm calm sea", "Seneca_on_anger"), (3, "stoic calm", "Plato"), (4, "calm", None), (5, "sea", "xPlatox")]
    x = Lexicon(spark, str(tmp_path / "x"))
    x.add(frame(spark, docs))
    q = spark.createDataFrame([(1, "calm", ["Seneca"], ["mind"]), (2, "calm", ["Seneca"], ["nosuch"]), (3, "sea calm", ["Plato", "seneca"], []), (4, "calm", [], [])], "query_id int, query string, authors array<string>, required array<string>")
    rows = {(r["query_id"], r["id"]) for r in x.author_search(q).collect()}
    assert rows == {(1, 1), (2, 1), (2, 2), (3, 3), (3, 5)}


def test_empty(spark, asked, tmp_path):
    x = Lexicon(spark, str(tmp_path / "x"))
    x.add(frame(spark, [(1, None, None), (2, "", "a")]))
    assert x.search(asked).collect() == [] and x.search(asked, whole=0).collect() == []
    assert x.search(asked.limit(0)).collect() == []
