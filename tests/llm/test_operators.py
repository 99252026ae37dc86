"""Each operator against a brute-force version on small tables, with the odd cases."""

import hashlib
import random
import re
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from lodestone.llm import components, counts, encoding, fingerprints, lattice, neardup, packing, pieces, pii, quality, sharding, tokens, toxicity

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")

ODD = [
    (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "s", 5), (2, None, None, None, None), (3, "", "de", "s", 0), (4, "one two", "en", "t", 7),
    (5, "alpha beta gamma delta epsilon zeta eta theta", "fr", "s", 5), (5, "alpha beta gamma delta epsilon zeta eta theta", "fr", "s", 5), (None, "no id here at all", "en", "s", 1),
    (7, "word " * 30_000, "en", "s", 150_000), (8, "x" * 100_000, "en", "s", 100_000), (9, "mail joe@example.org or +1 (017) 555-7713 é😀 10.0.0.1", "en", "s", 9),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, n_words int, spans string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns that clash with results."""
    return spark.createDataFrame([(*r, 1, 2, "x") for r in ODD], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, tiny):
    return spark.read.parquet(f"{tiny}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())


# -- 1 ------------------------------------------------------------------------------------


def repeated(words, k=8):
    seen = {}
    for i in range(len(words) - k + 1):
        seen.setdefault(tuple(words[i : i + k]), []).append(i)
    return len({i + j for at in seen.values() if len(at) > 1 for i in at for j in range(k)})


def test_quality_measures(texts, docs):
    got = {r["doc_id"]: r for r in quality.ledger(docs).collect()}
    for d, t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (got[d]["n_words"], got[d]["word_chars"], got[d]["n_repeat_words"], got[d]["n_dup_lines"]) == (len(words), sum(map(len, words)), repeated(words), len(lines) - len(set(lines)))


def test_quality_ablation(docs):
    rows = quality.apply_policy(quality.ledger(docs))
    bits = [r["failed_bits"] for r in rows.collect()]
    mask = quality.POLICIES[quality.CURRENT]
    for r in quality.ablation(rows).collect():
        bit = next(1 << x.bit for x in quality.RULES if x.name == r["rule"])
        assert r["n_failed"] == sum(1 for b in bits if b & bit) and r["n_only"] == sum(1 for b in bits if b & mask == bit) and r["n_kept_without"] == sum(1 for b in bits if b & mask & ~bit == 0)


def test_quality_odd(odd, none):
    assert quality.ledger(odd).count() == len(ODD) and quality.ledger(none).count() == 0
    assert quality.ledger(odd).where("doc_id = 2").first()["n_words"] == 0


# -- 2 ------------------------------------------------------------------------------------


def test_sharding(docs, odd, none):
    rows = sharding.assign(docs, 6).collect()
    size = {}
    for r in rows:
        size.setdefault(r["shard"], []).append(r)
    total = sum(r["size"] for r in rows)
    most = max(r["size"] for r in rows)
    assert sorted(size) == list(range(6)) and len(rows) == docs.count()
    for held in size.values():
        assert sorted(r["slot"] for r in held) == list(range(len(held)))
        assert abs(sum(r["size"] for r in held) - total / 6) <= 3 * most
    got = sharding.assign(odd, 3)
    assert got.count() == len(ODD) and got.where("doc_id IN (1, 5)").select("shard").distinct().count() == 1
    assert sharding.assign(none, 3).count() == 0


# -- 3 ------------------------------------------------------------------------------------


@pytest.mark.parametrize("ids", [[], [0], [255, 256, 65535, 65536, 2**32 - 1] * 300])
def test_codes(ids):
    c = tokens.Codes(tokens.pack_ids(ids))
    assert len(c) == len(ids) and list(c.all()) == ids and all(c[i] == ids[i] for i in range(len(ids)))


def test_token_table(docs, texts, odd, none):
    t = tokenizers.Tokenizer.from_file(public.path("word_bpe_49k.json"))
    got = {r["doc_id"]: r for r in tokens.read_documents(tokens.segments(docs, public.path("word_bpe_49k.json"), segment_tokens=5000)).collect()}
    start = 0
    for d, text in texts:
        ids = [*t.encode(text, add_special_tokens=False).ids, 2]
        assert (got[d]["start"], got[d]["n_tokens"], got[d]["ids_crc32"]) == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    table = tokens.segments(docs, public.path("word_bpe_49k.json"))
    d, text = texts[3]
    assert tokens.read_tokens(table, d, 2, 6) == t.encode(text, add_special_tokens=False).ids[2:6]
    rows = tokens.read_documents(tokens.segments(odd, public.path("word_bpe_49k.json"))).collect()
    assert len(rows) == len(ODD) and next(r for r in rows if r["doc_id"] == 2)["n_tokens"] == 1 and next(r for r in rows if r["doc_id"] is None)["start"] == 0
    assert tokens.read_documents(tokens.segments(none, public.path("word_bpe_49k.json"))).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_tokenizer(name, texts):
    e, rng = encoding.Encoder(public.path(name)), random.Random(1)
    odd = ["", "  ", "a  b", "a \n b", "don't we'll", "x y 　z", "é x́", "a\x1cb \x85c", "<|endoftext|> a", "ΟΔΟΣ", "𝔘𝔫 👍🏽"]
    odd += ["".join(rng.choice(" \n\t'abcdéA1.!\xa0 \x1ć|>") for _ in range(rng.randint(0, 40))) for _ in range(500)]
    odd += [t for _, t in texts[:40]]
    for text, got in zip(odd, e.encode(odd), strict=True):
        ids = e.tokenizer.encode(text, add_special_tokens=False).ids
        assert got == struct.pack(f"<{len(ids)}I", *ids)


# -- 4 ------------------------------------------------------------------------------------


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def plain_components(rows, percent=85):
    sets = [(d, shingle_set(t)) for d, t in rows]
    root = {d: d for d, _ in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                a_, b_ = top(a), top(b)
                root[max(a_, b_)] = min(a_, b_)
    return {d: top(d) for d, _ in sets}


def test_near_duplicates_of_chains(spark):
    """Copies of copies, each edited further: a large bucket whose ends are unlike each other."""
    rng = random.Random(3)
    rows, word = [], lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    for k in range(6):
        held = [[word() for _ in range(120)]]
        for _ in range(25):
            w = list(rng.choice(held))
            for _ in range(rng.randint(1, 3)):
                w[rng.randrange(len(w))] = word()
            held.append(w)
        rows += [" ".join(w) for w in held]
    rows += ["", "a b", "A  B", "a b c d e"]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == plain_components(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_small_blocks_change_nothing(spark, monkeypatch):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(60):
        w = list(base)
        for j in rng.sample(range(150), 4):
            w[j] = f"e{i}-{j}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(neardup, "BLOCK", 8)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == plain_components(rows)


def test_near_duplicates_odd(odd, none):
    got = neardup.near_duplicates(odd).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(ODD) and by[5]["component_id"] == 1 and by[2]["n_shingles"] == 0 and by[2]["kept"] and by[None]["component_id"] is None
    assert neardup.near_duplicates(none).count() == 0


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 300)] + [(1000, 2000), (2000, 3000), (None, 4)], "a long, b long")
    got = {r["id"]: r["label"] for r in components.components(links).collect()}
    assert {got[i] for i in range(1, 301)} == {1} and got[3000] == 1000 and len(got) == 303


# -- 5 ------------------------------------------------------------------------------------


def test_fingerprints(spark, tiny, texts):
    got = {r["doc_id"]: r for r in fingerprints.op5_bottom_k(spark, tiny).collect()}
    far = []
    for i, (d, t) in enumerate(texts):
        after = texts[(i + 1) % len(texts)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert got[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[d]["n_chars"] == len(t)
        a, b = shingle_set(t.lower()), shingle_set(edited.lower())
        far.append(abs(got[d]["near_edited"] - (len(a & b) / len(a | b) if a | b else 1)))
    assert sum(far) / len(far) < 0.05
    assert len({(r["fingerprint"], texts_of[r["doc_id"]]) for texts_of in [dict(texts)] for r in got.values()}) == len({t for _, t in texts})


def test_sketches_merge(spark):
    rows = spark.createDataFrame([("k", "a b c d e f g h"), ("k", "d e f g h i j k l"), ("z", "")], "key string, text string")
    parts = fingerprints.with_sketch(rows, "text", "sketch")
    merged = {r["key"]: r["sketch"] for r in fingerprints.merge_rows(parts, ["key"]).collect()}
    two = [r["sketch"] for r in parts.where("key = 'k'").collect()]
    assert merged["k"] == sorted(set(two[0]) | set(two[1]))[: fingerprints.K]
    row = parts.where("key = 'k'").select(fingerprints.resemblance(F.col("sketch"), F.col("sketch")).alias("r"), fingerprints.containment(F.col("sketch"), F.col("sketch")).alias("c"), fingerprints.distinct_shingles(F.col("sketch")).alias("n")).first()
    assert (row["r"], row["c"], row["n"]) == (1.0, 1.0, 4.0)


def neighbours(rows):
    """The text behind each (id, text)."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    return [(*r, order[(i + 1) % len(order)][1]) for i, r in enumerate(order)]


@pytest.mark.parametrize("ids", [[i * i for i in range(40)], [(i * 0x9E3779B97F4A7C15 + 2**63) % 2**64 - 2**63 for i in range(40)], [*range(39), 9 * 10**18], [-(2**63), 2**63 - 1, 0], [5]])
def test_fingerprints_of_any_ids(spark, ids):
    rows = [(d, f"text {i}") for i, d in enumerate(ids)]
    got = fingerprints.with_next(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", "sketch", 3).collect()
    assert sorted((r["doc_id"], r["text"], r["next_text"]) for r in got) == sorted(neighbours(rows))


def test_fingerprints_odd(spark, odd, none):
    """Repeated rows and null ids keep a row each, and each text stands behind one row."""
    rows = odd.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).union(spark.createDataFrame([(None, f"n {i}") for i in range(20)], "doc_id long, text string"))
    got = fingerprints.with_next(rows, "doc_id", "text", "sketch", 3).collect()
    assert sorted((r["doc_id"] or -1, r["text"]) for r in got) == sorted((r["doc_id"] or -1, r["text"]) for r in rows.collect())
    assert sorted(r["next_text"] for r in got) == sorted(r["text"] for r in got)
    assert fingerprints.with_next(none.select("doc_id", "text"), "doc_id", "text", "sketch").count() == 0
    sketch = next(r["sketch"] for r in got if r["doc_id"] == 3)
    assert sketch == []


def test_runs_are_even(spark):
    rows = spark.range(0, 5000).select(F.xxhash64("id").alias("doc_id"), F.col("id").cast("string").alias("text")).union(spark.createDataFrame([(9 * 10**18, "far"), (None, "none")], "doc_id long, text string"))
    starts = fingerprints.run_starts(rows, "doc_id", "text", 100)
    sizes = [r["count"] for r in rows.groupBy(fingerprints.run_of(starts, fingerprints.place("doc_id", "text")).alias("run")).count().collect()]
    assert sum(sizes) == 5002 and max(sizes) <= 100 and len(sizes) == len(starts)


def test_bottom_k_is_the_least_hashes(spark, docs):
    """The sketch against all shingle hashes, sorted outside Spark; the likeness to the next text by the definition."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    every = rows.withColumn("w", fingerprints.words(F.col("text"))).select("doc_id", fingerprints.shingle_hashes(F.col("w")).alias("h"))
    least = {r["doc_id"]: sorted(set(r["h"]))[: fingerprints.K] for r in every.collect()}
    got = fingerprints.with_next(rows, "doc_id", "text", "sketch").withColumn("near", fingerprints.resemblance(F.col("sketch"), F.col("next_sketch"))).collect()
    order = sorted(r["doc_id"] for r in got)
    behind = dict(zip(order, order[1:] + order[:1], strict=True))
    for r in got:
        a, b = least[r["doc_id"]], least[behind[r["doc_id"]]]
        both = sorted(set(a) | set(b))[: fingerprints.K]
        assert r["sketch"] == a and r["next_sketch"] == b
        assert r["near"] == (sum(x in a and x in b for x in both) / len(both) if both else 1.0)


# -- 6, 7 ---------------------------------------------------------------------------------


def samples():
    rng = random.Random(5)
    return ["", "a", "Hello world  this is\na testé ✓", "   ", "\n\n x", "x" * 300 + " y"] + ["".join(rng.choice("abcdeé thingaer  \n✓🤷;\r1") for _ in range(rng.randint(0, 60))) for _ in range(300)]


@pytest.fixture(scope="module")
def unigram():
    from tokenizers.models import Unigram

    p = pieces.read(public.path("piece_bpe_32k.model"))
    model = Unigram([(n, p.scores[n][1] if n in p.scores else 0.0) for n in p.names], 0, True)
    return [[t.id for t in model.tokenize(pieces.marked(t))] if t else [] for t in samples()]


def test_viterbi_counts(spark, unigram, odd, none):
    c = counts.Counter(pieces.read(public.path("piece_bpe_32k.model")))
    assert [c.text(t)[0] for t in samples()] == [len(w) for w in unigram]
    got = counts.token_counts(odd, public.path("piece_bpe_32k.model"))
    assert got.count() == len(ODD) and got.where("doc_id = 2").first()["n_tokens"] == 0
    assert counts.token_counts(none, public.path("piece_bpe_32k.model")).count() == 0


def test_lattice(spark, unigram, odd, none):
    model = public.path("piece_bpe_32k.model")
    df = spark.createDataFrame([*enumerate(samples())], "doc_id long, text string")
    rows = lattice.encode(df, model, group_bytes=4000)
    got = {r["doc_id"]: r for r in rows.collect()}
    assert [list(got[i]["ids"]) for i in range(len(unigram))] == unigram and all(r["decoded"] for r in got.values())
    back = {r["doc_id"]: r["text"] for r in lattice.decode(rows.select("doc_id", "ids"), model).collect()}
    assert [back[i] for i in range(len(unigram))] == samples()
    assert lattice.encode(odd, model).where("decoded").count() == len(ODD) and lattice.encode(none, model).count() == 0


def test_pieces_that_are_never_best(monkeypatch):
    scores = {"a": -1.0, "b": -1.0, "ab": -2.0, "ba": -2.5, "aba": -4.0, "bb": -1.5, "xa": -20.0, "ax": -5.0}
    held = pieces.Pieces({p: (i, s) for i, (p, s) in enumerate(scores.items())}, (), -15.0, (), 3)
    monkeypatch.setattr(pieces, "read", lambda path: held)
    kept = pieces.needed.__wrapped__("")
    assert set(kept) == {"a", "b", "ab", "bb", "ax"} and all(held.scores[p] == x for p, x in kept.items())


def test_lattice_of_very_long_words(spark):
    from tokenizers.models import Unigram

    path, rng = public.path("piece_bpe_32k.model"), random.Random(3)
    p = pieces.read(path)
    model = Unigram([(n, p.scores[n][1] if n in p.scores else 0.0) for n in p.names], 0, True)
    texts = ["".join(rng.choice("abcdeéthingaer") for _ in range(100_000)), "☃" * 3_000 + "🤷\U0001f9ff" * 500, "=" * 5_000, " " * 4_000 + "a"]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in lattice.encode(df, path).collect()}
    for i, text in enumerate(texts):
        ids = [t.id for t in model.tokenize(pieces.marked(text))]
        assert list(got[i]["ids"]) == ids and got[i]["decoded"]
        assert (got[i]["n_tokens"], got[i]["ids_crc32"]) == (len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))


# -- 8 ------------------------------------------------------------------------------------


def test_packing(spark, docs, texts, odd, none):
    t = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    rows = packing.pack(packing.pieces(docs, public.path("byte_bpe_50k.json")).persist()).collect()
    ids = {d: [*t.encode(x, add_special_tokens=False).ids, 0] for d, x in texts}
    by = {}
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(part)}I", *part)) and (len(ids[r["doc_id"]]) > 2048 or r["piece"] == 0)
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in by.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= 2048
    total = sum(map(len, ids.values()))
    assert sum(r["length"] for r in rows) == total and len(by) <= -(-total // 2048) + 2
    got = packing.pack(packing.pieces(odd, public.path("byte_bpe_50k.json")).persist())
    assert got.where("piece = 0").count() == len(ODD) and got.where("doc_id = 2").first()["length"] == 1
    assert packing.pack(packing.pieces(none, public.path("byte_bpe_50k.json"))).count() == 0


def test_best_two_fit_exchanges():
    assert [sorted(x) for x in packing.best_two_fit([6, 3, 2, 2], 10)] == [[0, 2, 3], [1]]
    rng = random.Random(2)
    lengths = [rng.randint(1, 2048) for _ in range(2000)]
    found = packing.best_two_fit(lengths)
    assert sorted(i for x in found for i in x) == list(range(2000)) and all(sum(lengths[i] for i in x) <= 2048 for x in found)
    assert len(found) <= sum(lengths) / 2048 * 1.05 + 1


# -- 9 ------------------------------------------------------------------------------------

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    odd = [int(c) for c in digits[-1::-2]]
    even = [2 * int(c) for c in digits[-2::-2]]
    return (sum(odd) + sum(x - 9 if x > 9 else x for x in even)) % 10 == 0


def plain_spans(text):
    out = []
    for k, (kind, p) in enumerate(PLAIN.items()):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 12 <= len(d) <= 19 and luhn(d) or kind == "phone" and 9 <= len(d) <= 15:
                out.append((m.start(), k, m.end(), kind))
    return ",".join(f"{n}:{s}:{e}" for s, _, e, n in sorted(out))


def test_base_spans(spark, texts):
    rng = random.Random(3)
    some = ["", "a@b.c.d@e.f a@b.c_d@e.f", "1.2.3.4.5.6.7.8 256.1.1.1 0000255.01.1.1", "4111 1111 1111 1111 +1 (017) 555-7713", "é😀+49 30 123456789"]
    some += ["".join(rng.choice("01255.@a-+ ()b_%é😀\n") for _ in range(rng.randint(0, 60))) for _ in range(800)] + [t for _, t in texts]
    df = spark.createDataFrame([*enumerate(some)], "doc_id long, text string")
    got = {r["doc_id"]: r["d"] for r in pii.with_spans(df).select("doc_id", pii.digest(F.col("base_spans")).alias("d")).collect()}
    assert [got[i] for i in range(len(some))] == [plain_spans(t) for t in some]


def test_added_spans_and_redaction(spark, odd, none):
    df = spark.createDataFrame([(1, "call 030 1234 5678 now; joe (at) mail (dot) com"), (2, "order 12345 on 2024-01-02, 3.14159265"), (3, "card 4111 1111 1111 1111.")], "doc_id long, text string")
    rows = {r["doc_id"]: r["text"] for r in pii.redact(pii.with_spans(df)).collect()}
    assert rows == {1: "call [PHONE] now; [EMAIL]", 2: "order 12345 on 2024-01-02, 3.14159265", 3: "card [CARD]."}
    plain = odd.select("doc_id", "text")
    assert pii.with_spans(plain).count() == len(ODD) and pii.with_spans(none.select("doc_id", "text")).count() == 0
    assert pii.redact(pii.with_spans(plain)).where("doc_id = 9").first()["text"] == "mail [EMAIL] or [PHONE] é😀 [IP]"


def test_trees_as_sql_equal_trees(spark):
    m = pii.model("phone")
    rows, _ = pii.examples("phone", 80)
    held = [{k: float(r[k]) for k in pii.USED["phone"]} for r in rows]
    df = spark.createDataFrame([tuple(r[k] for k in pii.USED["phone"]) for r in held], ", ".join(f"{k} double" for k in pii.USED["phone"]))
    got = [r[0] for r in df.select(F.expr(m.sql())).collect()]
    assert all(abs(a - m.probability(b)) < 1e-9 for a, b in zip(got, held, strict=True))


def test_classifier_accuracy():
    for kind in pii.USED:
        rows, labels = pii.examples(kind, seed=99)
        m = pii.model(kind)
        said = [m.probability({k: r[k] for k in pii.USED[kind]}) >= m.threshold for r in rows]
        hit = sum(1 for s, y in zip(said, labels, strict=True) if s and y)
        assert hit / max(1, sum(said)) >= 0.9 and hit / sum(labels) >= 0.5


# -- 10 -----------------------------------------------------------------------------------


def test_marginals_equal_the_long_recursion():
    import numpy as np

    m = toxicity.Model({b"bad": 5.0, b"odd": 2.0}, -4.0, (0.0, 0.5, 0.3, 1.0), (0.0, 1.0, 1.0, 1.0))
    m.prepare()
    n, at, w = 40, [0, 3, 4, 39], [5.0, 2.0, 5.0, 2.0]
    e = np.ones((n, 2))
    e[:, 1] = np.exp(-4.0)
    for i, x in zip(at, w, strict=True):
        e[i, 1] = np.exp(-4.0 + x)
    alpha, beta = [e[0]], [np.ones(2)]
    for i in range(1, n):
        alpha.append(alpha[-1] @ m.a * e[i])
        beta.append(m.a @ (e[n - i] * beta[-1]))
    full = [(alpha[i] * beta[n - 1 - i])[1] / (alpha[i] * beta[n - 1 - i]).sum() for i in at]
    assert np.allclose(m.marginals(n, at, w), full)


def test_toxicity_held_out(spark, odd, none):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(1200):
        words = [f"w{rng.randrange(400)}" for _ in range(60)]
        bad = i % 4 == 0
        if bad:
            for w in rng.sample(["scum", "moron", "trash", "idiot"], 2):
                words.insert(rng.randrange(60), w)
        rows.append((i, "".join("abcdefghij"[int(c)] if c.isdigit() else c for c in " ".join(words))))
        labels.append((i, 1, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    right = sum((got[i]["score"] >= toxicity.THRESHOLD) == (i % 4 == 0) for i in held)
    assert right / len(held) > 0.97
    i = next(i for i in held if i % 4 == 0)
    s, e = map(int, got[i]["toxic_spans"].split(",")[0].split(":"))
    assert dict(rows)[i][s:e] in ("scum", "moron", "trash", "idiot")
    assert toxicity.score(odd, model).count() == len(ODD) and toxicity.score(none, model).count() == 0
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in toxicity.score(odd, toxicity.fit(odd, empty)).collect()} == {0.0}
