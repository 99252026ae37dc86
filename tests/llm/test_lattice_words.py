"""Words that many documents have go through the lattice once, not once for each group, and which words these are changes no result."""

import random

import public_tokenizers as public
import pytest

from lodestone.llm import lattice

MODEL = public.path("piece_bpe_32k.model")
ODD = ["", None, "a mark ▁ in it", "é😀 ☃☃\n\n1234  x", "=" * 500, "Beta\tgamma " * 40]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["common", "words", "rare%d" % rng.randrange(10**6), "Other,"]) for _ in range(80)) for _ in range(60)]
    return spark.createDataFrame([(None if i == 3 else i, t) for i, t in enumerate([*texts, *ODD, *ODD])], "doc_id long, text string")


def key(rows):
    return sorted(map(repr, rows.collect()))


def test_common_words_change_no_result(docs, monkeypatch):
    want = key(lattice.encode(docs, MODEL, group_bytes=2000, most=0))
    assert len(want) == 72
    assert sum("decoded=False" in x for x in want) == 2  # a text with the mark decodes to a blank
    for most in (30, 1 << 19):
        assert key(lattice.encode(docs, MODEL, group_bytes=2000, most=most)) == want
    monkeypatch.setattr(lattice, "SAMPLE_BYTES", 9000)  # common words of a part of the documents
    monkeypatch.setattr(lattice, "PORTION", 7)  # long texts go piece by piece
    assert key(lattice.encode(docs, MODEL, group_bytes=2000)) == want


def test_groups_hold_no_common_words(spark, docs):
    numbers, raw, odd = lattice.common_words(docs, MODEL, 1, 2, most=30)
    assert 0 < len(numbers) <= 30 and len(raw) == len(numbers) and not odd and "▁common" in numbers
    groups = lattice.numbered(docs, spark.sparkContext.broadcast((numbers, raw, odd)), 2000).collect()
    assert len(groups) > 5 and sum(len(g["doc_ids"]) for g in groups) == 72
    for g in groups:
        assert not set(g["words"]) & set(numbers) and len(set(g["words"])) == len(g["words"])
        got = lattice.unpacked(bytes(g["numbers"]), sum(g["n_words"]))
        assert set(range(len(numbers), len(numbers) + len(g["words"]))) <= set(got.tolist())
