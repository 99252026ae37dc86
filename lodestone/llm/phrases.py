"""Phrase collocation mining: word sequences that occur together more often than apart.

Texts are lower-cased (A-Z), cut into pieces at punctuation and line ends and those into words at
blanks and tabs. Everything is per language. Four scans of the texts, each within its tasks:

1. ``sketch`` counts the two-word phrases by hash into cells, about as many as the corpus has
   words, and so bounds each phrase's count from above. Cells travel as sorted gaps and counts,
   dealt by block of cells; counts are clipped at ``least``, which changes no decision. Cells that
   reach ``least`` become a filter of bits, at most FILTER_BITS of them, which is broadcast.
2. The same for three to MOST words, of phrases all of whose pairs pass the first filter.
3. The phrases that pass are counted: a task sums up by hash, sends each phrase and its sum in
   packs dealt by the phrase, and the sums are added. No phrase that is frequent enough can be
   missing, since all its parts are at least as frequent; those that aren't are dropped.
4. The words of the frequent phrases become a filter, and words that pass are counted likewise.

The sums are exact counts; thresholds, scores and the list follow from them by joins of the
frequent phrases, which are far fewer than the words. Only filters are broadcast; what a worker
holds is SEEN phrases or one sketch's buffer. The scans are four whatever the corpus.

Defined cases: a null text counts as empty and has no words, a null language as ``und``. Repeated
rows count again. An empty table, or one without frequent phrases, gives an empty list. Texts are
taken whole; long ones in portions that overlap by MOST words where they can't be cut between pieces,
which only raises upper bounds; what lies wholly in an overlap is counted once. Other columns are dropped, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import SLICE_BYTES, arrow_rows, column, drop, keep, partitions, raw_texts, slices, worker_cache

LEAST, LIST, MOST, INSIDE = 100, 2000, 5, 100
FILTER_BITS = 1 << 27
BLOCK_BITS = 20
#: Cells that a worker gathers before it counts and passes them on.
BUFFER = 1 << 21
#: Phrases whose sums a worker holds before it passes them on.
SEEN = 500_000
#: Packs of phrases for each partition of a shuffle.
PACKS = 16

UPPER, LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
CUTS = b".,;:!?\n\x0b\x0c\r"
TABLE = bytes.maketrans(UPPER + b"\t" + CUTS, LOWER + b" " + b"\n" * len(CUTS))
WORD_MASK = (1 << 64) - 1
BASE, STEP, LAST, PRIME = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, (1 << 31) - 1
BASE_2 = 1_000_003


def clean(text: bytes) -> bytes:
    """Words between single blanks, pieces between line breaks."""
    out = text.translate(TABLE)
    return re.sub(b"  +", b" ", out) if b"  " in out else out


def cuts(text: bytes, size: int = SLICE_BYTES, back: int = MOST) -> Iterator[tuple[bytes, int]]:
    """A clean text in portions, and how many words of each were the last ones of the one before: none where it is cut between pieces, else back."""
    start, end, again_words = 0, size, 0
    while end < len(text):
        cut = text.rfind(b"\n", start, end)
        if cut > start:
            yield text[start:cut], again_words
            start, end, again_words = cut + 1, cut + 1 + size, 0
            continue
        cut = again = text.rfind(b" ", start, end)
        for _ in range(back):
            again = text.rfind(b" ", start, again) if again > start else -1
        if again <= start:
            end += size
            continue
        yield text[start:cut], again_words
        start, end, again_words = again + 1, again + 1 + size, back
    yield text[start:], again_words


def portions(text: bytes, size: int = SLICE_BYTES, back: int = MOST) -> Iterator[bytes]:
    """A clean text in portions: cut between pieces, or so that the next one begins with the last words of the one before."""
    return (part for part, _ in cuts(text, size, back))


class Powers:
    """Powers of the bases of the words' hashes, and the inverse ones."""

    def __init__(self) -> None:
        self.n = 0

    def upto(self, n: int):
        import numpy as np

        if n > self.n:
            self.n = n = max(n, 2 * SLICE_BYTES)
            self.up, self.down = (np.cumprod(np.full(n, b, "u8")) for b in (BASE, pow(BASE, -1, 1 << 64)))
            self.up_2, self.down_2 = (modular(b, n) for b in (BASE_2, pow(BASE_2, -1, PRIME)))
        return self


def modular(base: int, n: int):
    """base^1 … base^n modulo PRIME."""
    import numpy as np

    out = np.array([base], "u8")
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), PRIME)) % np.uint64(PRIME)])
    return out[:n]


class Words:
    """Words of some clean texts: where they are, their hashes, and the salt of their language."""

    def __init__(self, texts: list[bytes], salts: list[int], powers: Powers, second: bool = False) -> None:
        import numpy as np

        self.raw = b"\n".join(texts)
        a = np.frombuffer(self.raw, "u1")
        p, n = powers.upto(len(a)), len(a)
        ends = a == 10
        gap = ends | (a == 32)
        edge = np.diff(gap.astype("i1"), prepend=1, append=1)
        self.starts, self.ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        self.hash = self.sums(a.astype("u8") * p.up[:n]) * p.down[self.starts]
        if second:
            q = np.uint64(PRIME)
            self.hash_2 = self.sums(a.astype("u8") * p.up_2[:n]) % q * p.down_2[self.starts] % q
        self.piece = np.cumsum(ends, dtype="i4")[self.starts] if n else np.zeros(0, "i4")
        offsets = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
        self.text = np.searchsorted(offsets, self.starts, "right") - 1
        self.salt = np.array(salts, "u8")[self.text] if len(self.starts) else np.zeros(0, "u8")

    def sums(self, each):
        import numpy as np

        total = np.zeros(len(each) + 1, "u8")
        np.cumsum(each, out=total[1:])
        return total[self.ends] - total[self.starts]

    def single(self):
        """Hashes of the words by themselves."""
        import numpy as np

        return mixed(self.hash * np.uint64(STEP) + self.salt * np.uint64(3))

    def phrases(self, most: int = MOST) -> Iterator[tuple]:
        """(words, hash of the phrase that begins at each word, whether it is within a piece) for 2 to most words."""
        import numpy as np

        state = self.hash * np.uint64(STEP)
        for k in range(2, most + 1):
            if len(self.hash) < k:
                return
            state = (state[:-1] ^ (state[:-1] >> np.uint64(29))) * np.uint64(STEP) + self.hash[k - 1 :] * np.uint64(LAST)
            yield k, mixed(state + self.salt[: len(state)] * np.uint64(2 * k + 1)), self.piece[k - 1 :] == self.piece[: len(state)]


def mixed(x):
    import numpy as np

    for _ in range(2):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def salt(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


class Filter:
    """Cells that may be frequent, as bits: all that are, and few others."""

    def __init__(self, bits: int, at=None, words=None) -> None:
        import numpy as np

        self.bits = bits
        self.held = np.zeros(max(1, bits >> 6), "u8")
        if at is not None:
            self.held[at] = words

    def has(self, cells):
        import numpy as np

        place = cells & np.uint64(self.bits - 1)
        return (self.held[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def shared(words: Words, bits: int, pairs: Filter | None) -> Iterator[tuple]:
    """(words, cells, starts) of the phrases to count: pairs, or those longer ones all of whose pairs pass."""
    import numpy as np

    good = None
    for k, h, within in words.phrases(2 if pairs is None else MOST):
        cells = h >> np.uint64(64 - bits)
        if pairs is None:
            at = np.flatnonzero(within)
            yield k, cells[at], at
        elif k == 2:
            alive = good = within & pairs.has(cells)
        else:
            alive = alive[: len(h)] & good[k - 2 :][: len(h)] & within
            at = np.flatnonzero(alive)
            yield k, cells[at], at


def texts_of(batch) -> Iterator[tuple[list[bytes], list[str], int]]:
    """Clean texts and languages of a batch, about SLICE_BYTES at a time, and how many of the first words came before."""
    raw, langs = [t or b"" for t in raw_texts(batch)], [x or "und" for x in column(batch, "lang")]
    for i, j in slices(list(map(len, raw))):
        if len(raw[i]) > SLICE_BYTES:
            for part, before in cuts(clean(raw[i])):
                yield [part], [langs[i]], before
        else:
            yield list(map(clean, raw[i:j])), langs[i:j], 0


def packed(cells, bits: int, least: int) -> Iterator[tuple[int, bytes]]:
    """(block, its cells as gaps and counts) of all cells of a buffer. Gaps are written byte by byte plane, so that they compress."""
    import numpy as np

    found, n = np.unique(cells, return_counts=True)
    n = np.minimum(n, least).astype("<u4")
    block = (found >> np.uint64(BLOCK_BITS)).astype("i8")
    cuts = [*np.flatnonzero(np.diff(block, prepend=-1)).tolist(), len(found)]
    for i, j in zip(cuts, cuts[1:]):
        gaps = np.diff((found[i:j] & np.uint64((1 << BLOCK_BITS) - 1)).astype("<u4"), prepend=np.uint32(0))
        planes = np.stack([gaps, n[i:j]]).view("u1").reshape(2, j - i, 4).transpose(0, 2, 1)
        yield int(block[i]), np.ascontiguousarray(planes).tobytes()


def unpacked(payload: bytes):
    import numpy as np

    flat = np.frombuffer(payload, "u1").reshape(2, 4, -1).transpose(0, 2, 1)
    gaps, n = np.ascontiguousarray(flat).view("<u4")[..., 0]
    return np.cumsum(gaps, dtype="i8"), n


def sketch(docs: DataFrame, bits: int, least: int, pairs=None) -> DataFrame:
    """(block, cells): cells (64-bit numbers) that reach least, of pairs or, given the pairs' filter, of longer phrases."""

    def count(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        powers, held, n = worker_cache(("powers",), Powers), [], 0
        out = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["block", "payload"])
        for b in batches:
            for texts, langs, _ in texts_of(b):
                words = Words(texts, list(map(salt, langs)), powers)
                for _, cells, _ in shared(words, bits, pairs.value if pairs else None):
                    held.append(cells)
                    n += len(cells)
                if n >= BUFFER:
                    yield out(list(packed(np.concatenate(held), bits, least)))
                    held, n = [], 0
        if n:
            yield out(list(packed(np.concatenate(held), bits, least)))

    def add(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        total, block = np.zeros(1 << BLOCK_BITS, "u4"), None

        def done() -> Iterator:
            cells = np.flatnonzero(total >= least)
            if block is not None and len(cells):
                yield pa.RecordBatch.from_arrays([pa.array(cells + (block << BLOCK_BITS), pa.int64())], names=["cell"])

        for b in batches:
            for k, payload in zip(column(b, "block"), column(b, "payload"), strict=True):
                if k != block:
                    yield from done()
                    total[:], block = 0, k
                at, n = unpacked(payload)
                total[at] = np.minimum(total[at] + n, least)
        yield from done()

    cells = docs.mapInArrow(count, "block long, payload binary")
    return cells.repartition(partitions(docs.sparkSession), "block").sortWithinPartitions("block").mapInArrow(add, "cell long")


def filter_of(cells: DataFrame, bits: int) -> Filter:
    """The filter of cells(cell), as many bits as cells at most: its size is bounded whatever their number."""
    bits = min(FILTER_BITS, 1 << bits)
    place = F.col("cell").bitwiseAND(F.lit(bits - 1))
    bit = F.expr("shiftleft(1L, CAST(_place & 63 AS INT))")
    rows = cells.withColumn("_place", place).groupBy(F.shiftright("_place", 6).alias("at")).agg(F.bit_or(bit).alias("word")).toArrow()
    return Filter(bits, rows["at"].to_numpy(), rows["word"].to_numpy().view("u8"))


def passing(words: Words, bits: int, pairs, longer) -> Iterator[tuple]:
    """(words, hashes, starts) of the phrases of two to MOST words whose upper bounds all pass."""
    import numpy as np

    alive = good = None
    for k, h, within in words.phrases():
        cells = h >> np.uint64(64 - bits)
        if k == 2:
            alive = good = within & pairs.value.has(cells)
        else:
            n = len(h)
            alive = alive[:n] & alive[1 : n + 1] & good[k - 2 :][:n] & within & longer.value.has(cells)
        at = np.flatnonzero(alive)
        yield k, h[at], at


def passing_words(words: Words, bits: int, singles) -> Iterator[tuple]:
    """The same of single words."""
    import numpy as np

    h = words.single()
    at = np.flatnonzero(singles.value.has(h >> np.uint64(64 - bits)))
    yield 1, h[at], at


class Sums:
    """Occurrences by phrase, summed up by hash; those whose first hash is another phrase's stand alone."""

    def __init__(self) -> None:
        import numpy as np

        self.hashes, self.slot, self.n, self.second = np.zeros(0, "u8"), np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0, "u8")
        self.told: list[tuple[bytes, str]] = []
        self.alone: list[tuple[bytes, str, int]] = []

    def add(self, words: Words, langs: list[str], found: list[tuple]) -> None:
        """found: (words, hashes, starts) of occurrences."""
        import numpy as np

        again = []
        for k, _, at in found:
            x = words.hash_2[at]
            for i in range(1, k):
                x = (x * np.uint64(BASE_2 + 7 * i) + words.hash_2[at + i]) % np.uint64(PRIME)
            again.append(x)
        h, at, again = np.concatenate([f[1] for f in found]), np.concatenate([f[2] for f in found]), np.concatenate(again)
        size = np.concatenate([np.full(len(f[2]), f[0]) for f in found])
        if not len(h):
            return
        tell = lambda i: (words.raw[words.starts[at[i]] : words.ends[at[i] + size[i] - 1]], langs[words.text[at[i]]])
        each, first, group = np.unique(h, return_index=True, return_inverse=True)
        same = again == again[first[group]]
        self.alone += [(*tell(i), 1) for i in np.flatnonzero(~same)]
        n = np.bincount(group[same], minlength=len(each))
        place = np.searchsorted(self.hashes, each)
        known = np.zeros(len(each), bool)
        inside = place < len(self.hashes)
        known[inside] = self.hashes[place[inside]] == each[inside]
        slots = self.slot[place[known]]
        agree = self.second[slots] == again[first[known]]
        self.n[slots[agree]] += n[known][agree]
        self.alone += [(*tell(i), int(c)) for i, c in zip(first[known][~agree], n[known][~agree])]
        new = first[~known]
        self.hashes = np.insert(self.hashes, place[~known], each[~known])
        self.slot = np.insert(self.slot, place[~known], np.arange(len(new)) + len(self.told))
        self.n, self.second = np.concatenate([self.n, n[~known]]), np.concatenate([self.second, again[new]])
        self.told += map(tell, new.tolist())


def tally(docs: DataFrame, occurrences, least: int, buffer: int, all_words: bool = False) -> DataFrame:
    """(lang, phrase, f): sums of occurrences(words), which gives (words, hashes, starts), that reach least; with all_words, also all words of each language, as the null phrase.

    A frequent phrase is in nearly every task's texts, so phrases travel in packs, dealt by hash:
    a task sends a few rows instead of one for each phrase that it has met.
    """
    n_parts = partitions(docs.sparkSession)
    n_packs = PACKS * n_parts

    def find(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        powers, sums, total = worker_cache(("powers",), Powers), Sums(), {}

        def out(packs: dict):
            rows = [pa.array([p for p, _ in packs], pa.int32()), pa.array([x for _, x in packs], pa.string()), pa.array([b"\n".join(p) for p, _ in packs.values()], pa.binary()), pa.array([np.array(n, "<i8").tobytes() for _, n in packs.values()], pa.binary())]
            return pa.RecordBatch.from_arrays(rows, names=["pack", "lang", "phrases", "sums"])

        def sent() -> Iterator:
            packs: dict = {}
            for phrase, lang, n in [*((*t, n) for t, n in zip(sums.told, sums.n.tolist(), strict=True)), *sums.alone]:
                phrases, ns = packs.setdefault((zlib.crc32(phrase) % n_packs, lang), ([], []))
                phrases.append(phrase), ns.append(n)
            if packs:
                yield out(packs)

        for b in batches:
            for texts, langs, before in texts_of(b):
                words = Words(texts, list(map(salt, langs)), powers, second=True)
                if all_words:
                    for i, n in enumerate(np.bincount(words.text, minlength=len(texts)).tolist()):
                        total[langs[i]] = total.get(langs[i], 0) + n - before
                found = list(occurrences(words))
                if before:
                    found = [(k, h[at + k > before], at[at + k > before]) for k, h, at in found]
                if found:
                    sums.add(words, langs, found)
                if len(sums.told) + len(sums.alone) > buffer:
                    yield from sent()
                    sums = Sums()
        yield from sent()
        if total:
            yield out({(-1, x): ([b""], [n]) for x, n in total.items()})

    def unite(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        held: dict = {}
        pack = None

        def done() -> Iterator:
            rows = [(lang, phrase, n) for (lang, phrase), n in held.items() if n >= least or pack == -1]
            if rows:
                lang, phrase, n = zip(*rows)
                text = pa.array([None] * len(rows) if pack == -1 else phrase, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), text, pa.array(n, pa.int64())], names=["lang", "phrase", "f"])

        for b in batches:
            for k, lang, phrases, sums in zip(*(column(b, c) for c in ("pack", "lang", "phrases", "sums")), strict=True):
                if k != pack:
                    yield from done()
                    held, pack = {}, k
                for phrase, n in zip(phrases.split(b"\n"), np.frombuffer(sums, "<i8").tolist(), strict=True):
                    held[lang, phrase] = held.get((lang, phrase), 0) + n
        yield from done()

    packs = docs.mapInArrow(find, "pack int, lang string, phrases binary, sums binary")
    return packs.repartition(n_parts, "pack").sortWithinPartitions("pack").mapInArrow(unite, "lang string, phrase string, f long")


def word_cells(singles: DataFrame, bits: int) -> DataFrame:
    """(cell) of words(lang, phrase)."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        powers = worker_cache(("powers",), Powers)
        for b in batches:
            if b.num_rows:
                words = Words([x.encode() for x in column(b, "phrase")], list(map(salt, column(b, "lang"))), powers)
                yield pa.RecordBatch.from_arrays([pa.array((words.single() >> np.uint64(64 - bits)).astype("i8"))], names=["cell"])

    return singles.mapInArrow(run, "cell long")


def phrase_counts(docs: DataFrame, least: int = LEAST, buffer: int = SEEN) -> DataFrame:
    """(lang, phrase, f) of words and phrases of docs(text, lang): every phrase of two to MOST words that occurs least times or more, and every word of those. The row with a null phrase counts all words of the language. A worker holds the sums of about buffer phrases."""
    spark = docs.sparkSession
    arrow_rows(spark)
    docs = docs.select("text", "lang")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(16, (size // 6).bit_length())
    send = spark.sparkContext.broadcast
    pairs = send(filter_of(sketch(docs, bits, least), bits))
    longer = send(filter_of(sketch(docs, bits, least, pairs), bits))
    found = keep(tally(docs, lambda words: passing(words, bits, pairs, longer), least, buffer), "phrases")
    singles = keep(found.select("lang", F.explode(F.split("phrase", " ")).alias("phrase")).distinct(), "words")
    held = send(filter_of(word_cells(singles, bits), bits))
    words = tally(docs, lambda words: passing_words(words, bits, held), 0, buffer, all_words=True)
    wanted = words.join(singles.withColumn("_w", F.lit(True)), ["lang", "phrase"], "left").where("phrase IS NULL OR _w").select("lang", "phrase", "f")
    return keep(found.union(wanted), "counts", [found, singles])


def collocations(counts: DataFrame, least: int = LEAST, top: int = LIST, inside: int = INSIDE) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) from counts(lang, phrase, f): the first top of each language."""
    n = F.broadcast(counts.where("phrase IS NULL").select("lang", F.col("f").alias("n")))
    known = counts.where("phrase IS NOT NULL").select("lang", "phrase", "f")
    kept = known.where(F.col("f") >= least).withColumn("_w", F.split("phrase", " ")).where(F.size("_w") > 1)
    part = lambda at, size: F.array_join(F.slice("_w", at, size), " ")
    cut = kept.select("lang", "phrase", F.col("f").alias("a"), "_w", F.explode(F.sequence(F.lit(1), F.size("_w") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.size("_w")).alias("rest"))
    left, right = (known.select("lang", F.col("phrase").alias(p), F.col("f").alias(c)) for p, c in (("first", "l"), ("rest", "r")))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    cut = cut.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(n, "lang")
    cut = cut.select("lang", "phrase", "a", "k", "l", "r", "n", (F.lit(1000).cast("decimal(4,0)") * wide("a") * wide("n")).alias("_p"), (wide("l") * wide("r")).alias("_q"))
    low = cut.withColumn("score", F.expr("_p div _q")).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("_m"))
    subs = F.flatten(F.transform(F.sequence(F.lit(2), F.size("_w") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.size("_w") - m + 1), lambda i: F.array_join(F.slice("_w", i, m), " "))))
    longer = kept.where(F.size("_w") > 2).select("lang", F.explode(subs).alias("phrase"), F.col("f").alias("_f")).groupBy("lang", "phrase").agg(F.max("_f").alias("_f"))
    rest = low.join(longer, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("_f") < inside * F.col("a"), F.lit(True)))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    rows = rest.select("lang", "phrase", "a", "_m.l", "_m.r", "n", "_m.score").withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return rows.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrases(spark, sf_dir: str) -> DataFrame:
    """The first phrases of each language of all documents."""
    return collocations(phrase_counts(spark.read.parquet(f"{sf_dir}/documents.parquet")))
