"""The near-duplicates stage against brute force at its own likeness, 0.8."""

import random
from fractions import Fraction

import corpus_pipeline
import pytest

from lodestone.llm import neardup


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def likeness(x, y):
    return Fraction(len(x & y), len(x | y)) if x and y else 0


def groups(rows, least):
    sets = [(d, shingle_set(t)) for d, t in rows]
    label = {d: d for d, _ in sets}
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if likeness(x, y) >= least and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = {d: low if v == high else v for d, v in label.items()}
    return label


@pytest.fixture(scope="module")
def rows():
    """Pairs about 0.8, a chain of copies with one link just above 0.8, and a pair of exactly 0.8."""
    rng, word = random.Random(5), iter(range(10**6))
    fresh = lambda n: [f"w{next(word)}" for _ in range(n)]
    texts = []
    for k in range(60):
        w = fresh(200)
        other = list(w)
        for j in rng.sample(range(2, 40), rng.randint(2, 5)):  # each word changed takes five shingles
            other[5 * j - 3] = next(iter(fresh(1)))
        texts += [w, other]
    a = fresh(204)
    b = a[:182] + fresh(22)
    c = b[:3] + fresh(1) + b[4:]
    texts += [a, b, c]
    d = fresh(94)
    texts += [d, d[:84] + fresh(10)]  # 80 of 100 shingles
    return [(i, " ".join(w)) for i, w in enumerate(texts)]


def test_stage_links_from_0_8(spark, rows):
    x, y = (shingle_set(t) for _, t in rows[-2:])
    assert likeness(x, y) == Fraction(4, 5)
    low, high = groups(rows, Fraction(4, 5)), groups(rows, Fraction(85, 100))
    assert low != high
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"] for r in corpus_pipeline.near(spark, docs, "").collect()}
    assert got == {d for d, v in low.items() if d == v}
    of = lambda *a: {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs, *a).collect()}
    assert of(80) == low and of() == high


def test_stage_on_the_documents(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    label = groups(sorted((r["doc_id"], r["text"]) for r in docs.collect()), Fraction(4, 5))
    assert {r["doc_id"] for r in corpus_pipeline.near(spark, docs, tiny).collect()} == {d for d, v in label.items() if d == v}


def test_scheme_misses_few():
    """The chance, from the binomial law, that a pair at the percentage shares no chunk but for one position."""
    
    for percent in (80, 85):
        s, p = neardup.scheme(percent), percent / 100
        one = p**5 + 5 * p**4 * (1 - p)
        n = 5 * s.chunks
        assert (1 - one) ** s.chunks < 1e-6
    assert neardup.scheme(85) == neardup.Scheme(85, 8)
