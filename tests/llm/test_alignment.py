"""Alignment of two tokenizers, against plain encoders and all pairs of byte ranges."""

import hashlib
from collections import Counter
from functools import cache

import public_tokenizers as public
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.llm import alignment as al

A, B = public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")


@cache
def plain_tools():
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    return a, b, al.byte_level(a.get_vocab()), al.Aligner(A, B)


def plain(text):
    """(A's ids, B's, groups, links) from the whole text, by byte ranges."""
    a, b, pieces, _ = plain_tools()
    if not text:
        return [], [], [], []
    x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    px = [pieces[i] for i in x]
    py = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
    whole = (" " + text).encode()
    if b"".join(px) != whole or b"".join(py) != whole:
        return [], [], [], []
    ends = lambda ps: [sum(map(len, ps[: i + 1])) for i in range(len(ps))]
    ex, ey = ends(px), ends(py)
    both, groups, links = sorted(set(ex) & set(ey)), [], []
    start = 0
    for end in both:
        groups.append(([i for i, e in zip(x, ex) if start < e <= end], [i for i, e in zip(y, ey) if start < e <= end]))
        start = end
    for i, e, p in zip(x, ex, px):
        for j, f, q in zip(y, ey, py):
            if max(e - len(p), f - len(q)) < min(e, f):
                links.append((i, j))
    return x, y, groups, links


def digest(groups):
    return hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups).encode()).hexdigest() if groups else ""


def check(text):
    x, y, groups, links = plain(text)
    ((na, nb, ng, sha, pairs, times),) = plain_tools()[3].documents([text])
    assert (na, nb, ng, sha) == (len(x), len(y), len(groups), digest(groups)), text
    assert dict(zip(pairs.tolist(), times.tolist())) == dict(Counter((i << 32) | j for i, j in links)), text


HARD = ["a", " a", "a ", "  ", "\n", "a\n\nb c", "x;\r\ny", "don't   stop\t now", "é ﬁ ▁ x", "<s> <|endoftext|> <0x41>", "日本 語。", "a\xa0b   c", "1234 5,6", "ab\n  cd", "q" * 300, "\x00 \x85", "🙂🙂 ok", " \n x", "x\t\r y", "ə, ɏ. ʯ;"]


def test_hard_texts():
    for t in HARD:
        check(t)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(list("aeTh'.,;1 \n\t\r") + ["  ", " th", "ing", "é", "ß", "日", "\xa0", "▁", "()", "\r\n"]), max_size=40).map("".join))
def test_cuts_are_safe(text):
    check(text)


def test_long_text_in_portions():
    text = ("Some words, and more; " * 70_000)[: (1 << 20) + 5000]
    al_ = plain_tools()[3]
    ((na, nb, ng, sha, pairs, times),) = al_.documents([text])
    a, b = plain_tools()[:2]
    assert na == len(a.encode(" " + text, add_special_tokens=False).ids) and nb == len(b.encode(text)) and times.sum() == na + nb - ng


def test_query_against_all_pairs(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", F.when(F.col("doc_id") % 50 != 7, F.substring("text", 1, 600)).alias("text"), F.lit(1).alias("pairs"), F.lit(2).alias("n"))
    docs = docs.union(docs.where("doc_id < 3")).union(docs.where("doc_id = 4").withColumn("doc_id", F.lit(None).cast("long")))
    texts = [(r[0], r[1] or "") for r in docs.select("doc_id", "text").collect()]
    each = [(i, *plain(t)) for i, t in texts]
    n = Counter(p for r in each for p in r[4])
    top = {}
    for (_, b), k in n.items():
        top[b] = max(top.get(b, 0), k)
    want = sorted(repr((i, len(x), len(y), len(g), len(links), sum(n[p] == top[p[1]] for p in links), sum(n[p] for p in links), digest(g))) for i, x, y, g, links in each)
    for most in (al.BROADCAST_PAIRS, 10):  # broadcast, and shuffled
        assert sorted(repr(tuple(r)) for r in al.alignment(docs, A, B, most).collect()) == want
    assert al.alignment(docs.limit(0), A, B).collect() == []
