"""Addresses in words, and numbers side by side."""

import random
import re

from pyspark.sql import functions as F

from lodestone.llm import pii


def found(spark, texts):
    """The texts of all spans with their kinds, for each text."""
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.with_spans(df).select("doc_id", "spans").collect()}
    return [[(pii.KINDS[s["kind"]], t[s["s"] : s["e"]]) for s in got[i]] for i, t in enumerate(texts)]


def test_addresses_with_a_plain_at(spark):
    texts = ["mail jane at example.com", "write to jane at example[dot]com", "mail jane at example dot com", "see you at noon."]
    assert found(spark, texts) == [[("email", "jane at example.com")], [("email", "jane at example[dot]com")], [("email", "jane at example dot com")], []]


def test_gates_hold_for_every_match(spark):
    """A text that a pattern matches passes the pattern's plain test."""
    rng = random.Random(1)
    parts = ["jane", "x.org", "@", " at ", "[at]", "(at)", "[at)", "(at]", " (at) ", ".", " dot ", "[dot]", "(dot)", "+49 ", "030 1234", "4111", "10.0.0.1", " ", "-", "com"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for name, p in (pii.BASE | pii.GENERATORS).items():
        assert df.where(F.col("t").rlike(p) & ~pii.NEEDS[name](F.col("t"))).count() == 0, name
    assert any(re.search(r"[a-z] at x\.org", t) and "@" not in t for t in texts)


def test_numbers_side_by_side(spark):
    texts = [
        "call 555-123-4567 (555) 987-6543 now", "Tel. 030 12345678 2024-01-02", "+49 30 123456789 (555) 123-4567",
        "4111 1111 1111 1111 (555) 123-4567", "cards 4111111111111112 4111111111111113", "order 12345 on 2024-01-02, 3.14159265",
    ]
    assert found(spark, texts) == [
        [("phone", "555-123-4567"), ("phone", "(555) 987-6543")], [("phone", "030 12345678")], [("phone", "+49 30 123456789"), ("phone", "(555) 123-4567")],
        [("card", "4111 1111 1111 1111"), ("phone", "(555) 123-4567")], [("card", "4111111111111112"), ("card", "4111111111111113")], [],
    ]


def test_candidates_are_all_parts_of_runs(spark):
    """Against plain loops over the groups of each run; texts with characters of more than one byte."""
    rng = random.Random(2)
    texts = ["".join(rng.choice(["12", "345", "6789", "1234567890123", " ", "-", ".", "(", ") ", "+", "é😀 ", "a "]) for _ in range(rng.randint(3, 24))) for _ in range(300)]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, _text string")
    df = pii.with_matches(df, "_text", pii.BASE | pii.GENERATORS).withColumn("base_spans", pii.base_spans())
    for r in pii.with_candidates(df).select("doc_id", "base_spans", "_m_number", "_number").collect():
        t, want = texts[r["doc_id"]], set()
        for m in r["_m_number"]:
            groups = [(g.start() + m["s"], g.end() + m["s"], len(g[0].lstrip("+("))) for g in re.finditer(r"[+(]?[0-9]+", m["m"])]
            want.add((m["s"], m["e"]))
            for i in range(len(groups)):
                for j in range(i, len(groups)):
                    s, e = groups[i][0], groups[j][1]
                    inside = e < m["e"] and t[e] == ")" and re.search(r"\([^)]*$", t[s:e])
                    if 9 <= sum(g[2] for g in groups[i : j + 1]) <= 19 and not inside:
                        want.add((s, e))
        want = {(s, e) for s, e in want if not any(b["s"] < e and s < b["e"] for b in r["base_spans"])}
        got = [(x["s"], x["e"]) for x in r["_number"]]
        assert len(got) == len(set(got)) and set(got) == want
        assert all(x["m"] == t[x["s"] : x["e"]] and x["b"] == t[max(0, x["s"] - 24) : x["s"]] and x["a"] == t[x["e"] : x["e"] + 2] for x in r["_number"])
