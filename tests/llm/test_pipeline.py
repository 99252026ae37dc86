"""Each stage of the pipeline against a plain version over what its predecessor kept."""

import re
import struct
import zlib

import corpus_pipeline
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lodestone.llm import pii, quality, toxicity
from lodestone.llm.common import keep
from tests.llm.test_operators import plain_components, plain_spans


def rows(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    held = rows(docs)

    after = keep(stages["toxicity"](spark, docs, tiny), "t1")
    model = toxicity.fit(docs, spark.read.parquet(f"{tiny}/labels.parquet"))
    model.prepare()
    held = {d: t for d, t in held.items() if model.document(t.encode())[0] < toxicity.THRESHOLD}
    assert rows(after) == held and sorted(after.columns) == sorted(docs.columns)

    docs, after = after, keep(stages["quality rules"](spark, after, tiny), "t2")
    bits = {r["doc_id"]: r["failed_bits"] for r in quality.ledger(docs).collect()}
    held = {d: t for d, t in held.items() if not bits[d] & quality.POLICIES[quality.CURRENT]}
    assert rows(after) == held

    after = keep(stages["near duplicates"](spark, after, tiny), "t3")
    group = plain_components(sorted(held.items()), 80)
    held = {d: t for d, t in held.items() if group[d] == d}
    assert rows(after) == held

    docs, after = after, keep(stages["personal data"](spark, after, tiny), "t4")
    got = rows(after)
    assert got.keys() == held.keys()
    for d, t in held.items():
        if not re.search(r"[0-9@]| at |\(at|\[at", t):
            assert got[d] == t
        assert not plain_spans(got[d])
    spans = {r["doc_id"]: r["spans"] for r in pii.with_spans(docs.select("doc_id", "text")).collect()}
    for d, found in spans.items():
        said, at = "", 0
        for s in found:
            if s["s"] >= at:
                said += held[d][at : s["s"]] + f"[{pii.KINDS[s['kind']].upper()}]"
            at = max(at, s["e"])
        assert got[d] == said + held[d][at:]

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    last = stages["packing"](spark, after, tiny).collect()
    ids = {d: [*t.encode(x, add_special_tokens=False).ids, 0] for d, x in got.items()}
    for r in last:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
    assert sum(r["length"] for r in last) == sum(map(len, ids.values()))
    whole = corpus_pipeline.run(spark, tiny).collect()
    key = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, whole)) == sorted(map(key, last))


ODD = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, spans string, _run int"
CLEAN = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)} and" for i in range(60))
ROWS = [
    (1, CLEAN, "en", "s", 1, 0.5, True, "x", 1), (1, CLEAN, "en", "s", 1, 0.5, True, "x", 1), (2, CLEAN, None, None, None, None, None, None, None), (None, CLEAN + " tail", "en", "s", 1, 0.5, False, "x", 1),
    (4, None, "en", "s", 1, 0.5, False, "x", 1), (5, "", "en", "s", 0, 0.5, False, "x", 1), (6, " ".join(f"z{i}q" for i in range(40_000)), "en", "s", 1, 0.5, False, "x", 1), (7, "y" * 60_000, "en", "s", 1, 0.5, False, "x", 1),
]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_of_odd_tables(spark, tiny, name):
    """Nulls in any column, empty and very long texts, repeated rows and ids, columns that clash with those the stages make, and no rows at all."""
    stage = dict(corpus_pipeline.STAGES)[name]
    odd, none = spark.createDataFrame(ROWS, ODD), spark.createDataFrame([], ODD)
    got = [(r["doc_id"], r["text"] if "text" in r else None) for r in map(lambda r: r.asDict(), stage(spark, odd, tiny).collect())]
    ids = sorted(str(d) for d, _ in got)
    assert stage(spark, none, tiny).count() == 0
    everything = sorted(str(r[0]) for r in ROWS)
    if name == "toxicity" or name == "personal data":
        assert ids == everything
    elif name == "quality rules":
        assert ids == sorted(["1", "1", "2", "None", "6"])
    elif name == "near duplicates":
        assert ids == sorted(["1", "1", "None", "4", "5", "6", "7"])
    else:
        assert sorted(set(ids)) == sorted(set(everything)) and ids.count("1") == 2 * ids.count("2")
