"""Phrase mining reads the corpus a fixed number of times, and counts overlaps of portions once."""

import random
from collections import Counter

from lodestone.llm import phrases
from tests.llm.test_phrases import ROWS, plain


def test_scans_do_not_grow_with_the_phrases(spark):
    seen = spark.sparkContext.accumulator(0)

    def watch(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    docs = spark.createDataFrame(ROWS, "text string, lang string").mapInArrow(watch, "text string, lang string")
    counts = phrases.phrase_counts(docs, 1, 40)
    assert seen.value <= 5 * len(ROWS)
    assert sorted(map(tuple, phrases.collocations(counts, 1, 5).collect())) == plain(ROWS, 1, 5)


def test_portions_count_each_occurrence_once():
    r = random.Random(4)
    text = phrases.clean(" ".join(r.choice(["a", "bb", "c.", "dd", "e"]) for _ in range(400)).encode())
    words = lambda t, k: [tuple(p.split()[i : i + k]) for p in t.split(b"\n") for i in range(len(p.split()) - k + 1)]
    for size in (12, 30, 50):
        for k in range(1, 6):
            got = Counter()
            for part, before in phrases.cuts(text, size):
                got.update(words(part, k))
                got.subtract(words(b" ".join(part.split()[:before]), k))
            assert +got == Counter(words(text, k))


def test_equal_first_hashes_are_told_apart():
    powers, sums = phrases.Powers(), phrases.Sums()
    for text in (b"a b", b"a b a c", b"a c"):
        words = phrases.Words([text], [1], powers, second=True)
        at = phrases.Words([text], [1], powers).starts[:-1] // 2
        sums.add(words, ["en"], [(2, at.astype("u8") * 0, at)])  # all pairs have the hash 0
    got = Counter()
    for (phrase, _), n in [*zip(sums.told, sums.n.tolist()), *(((p, x), n) for p, x, n in sums.alone)]:
        got[phrase] += n
    assert got == {b"a b": 2, b"b a": 1, b"a c": 2}
