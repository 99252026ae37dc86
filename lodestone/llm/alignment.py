"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text.

A is a byte-level vocabulary over space + text, B a SentencePiece one over text, to which it adds
the space itself. A transducer reads both: its state is the side that leads and the bytes by which
it does. While a side leads, the other side's next token is taken; it is linked with the leading
token, and what is left over of the longer one is the next state. A group closes when nothing is
left. Transitions are remembered by state and token.

Texts are cut where neither tokenizer has a token across (``Cutter``), so tokens and groups of a
piece are the same wherever it stands, and workers remember those of pieces met lately, in
KEPT_BYTES at most. Counts of linked id pairs are summed up over the corpus and joined back to the
documents' own pairs, which a document holds as two arrays. Pair counts are broadcast up to
BROADCAST_PAIRS rows (some 100 MB in memory); beyond, the same join is shuffled, with pairs dealt
over SALTS parts, since a pair like that of a blank and an article is in nearly every document.

Defined cases: a null or empty text, and one whose joined tokens of either side aren't space +
text, has no tokens: zeros and an empty digest, and it adds to no count. Repeated rows and null
ids keep a row each. An empty table gives one. Texts are taken whole, in portions; a stretch
without any cut is one piece, however long. Other columns are dropped, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import Recent, arrow_rows, column, keep, slices, worker_cache
from lodestone.llm.encoding import RUN, WHITE, Encoder

KEPT_BYTES = 96 << 20
KEPT_CHARS = 64
PORTION = 50_000
#: Transitions and pairs that a worker holds before it forgets or passes them on.
MOST_STATES, MOST_PAIRS = 200_000, 500_000
BROADCAST_PAIRS = 2_000_000
SALTS = 32

#: Before a piece: B never merges a line break with anything.
GUARD = "\n"
#: Where all white space is blanks, tabs and line breaks: a word with its blank, or white space with the word behind it.
FINE = re.compile(rf" ?{RUN}| ?[^{WHITE}]+|\n(?=[^{WHITE}])|[{WHITE}]+[^{WHITE}]*")
#: Elsewhere cuts are only before a blank behind something that isn't white.
COARSE = re.compile(rf"[{WHITE}]*[^{WHITE}]+(?:(?! )[{WHITE}]+[^{WHITE}]*)*|[{WHITE}]+")
ODD = re.compile(rf"(?![ \t\n])[{WHITE}]").search


class Known(Recent):
    """Of tuples that hold a text and bytes at their end."""

    def put(self, word, value) -> None:
        super().put(word, value)
        self.size += 200 + sum(map(len, value[3:]))


def byte_level(tokens: dict[str, int]) -> list[bytes]:
    """Bytes of the tokens of a byte-level vocabulary: printable bytes stand for themselves, the others for characters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shown = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
    out = [b""] * (max(tokens.values()) + 1)
    for token, i in tokens.items():
        out[i] = bytes(shown[c] for c in token) if all(c in shown for c in token) else token.encode()
    return out


class Aligner:
    def __init__(self, path_a: str, path_b: str) -> None:
        import sentencepiece

        self.encoder = Encoder(path_a)
        self.a = byte_level(self.encoder.tokenizer.get_vocab())
        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path_b)
        n = sp.get_piece_size()
        self.b = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in range(n)]
        self.guard = sp.encode(GUARD)
        plain = [sp.id_to_piece(i) for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        across = re.compile(r"[A-Za-zÀ-ÖØ-öø-ʯ][\x00-@\[-`{-\x7f]|[^▁]▁|.\n|\n.|[^\r][\t]|\t.", re.DOTALL).search
        if any(map(across, plain)) or len(self.guard) != 2:
            raise ValueError("a piece of B goes beyond a cut")
        self.kept, self.states = Known(KEPT_BYTES), {}
        self.names = list(map(str, range(max(len(self.a), n))))

    def step(self, leads: int, rest: bytes, token: int) -> tuple[int, bytes] | None:
        """Which side leads by which bytes when the other side's next token is read; None if the bytes differ."""
        key = (leads, rest, token)
        if key not in self.states:
            if len(self.states) >= MOST_STATES:
                self.states.clear()
            new = (self.b if leads == 0 else self.a)[token]
            if rest.startswith(new):
                self.states[key] = (leads, rest[len(new) :])
            else:
                self.states[key] = (1 - leads, new[len(rest) :]) if new.startswith(rest) else None
        return self.states[key]

    def align(self, ids: tuple, whole: bytes) -> tuple[list[tuple[list[int], list[int]]], list[tuple[int, int]]] | None:
        """(groups, links) of the tokens of both sides; None if they don't spell the same bytes, or not the whole."""
        pieces, at = (self.a, self.b), [0, 0]
        if b"".join([self.a[i] for i in ids[0]]) != whole:
            return None
        groups, links, n = [], [], (len(ids[0]), len(ids[1]))
        while at[0] < n[0]:
            first = list(at)
            last = [ids[0][at[0]], 0]
            leads, rest = 0, pieces[0][last[0]]
            at[0] += 1
            while rest:
                other = 1 - leads
                if at[other] >= n[other]:
                    return None
                last[other] = ids[other][at[other]]
                at[other] += 1
                links.append((last[0], last[1]))
                if (state := self.step(leads, rest, last[other])) is None:
                    return None
                leads, rest = state
            groups.append((ids[0][first[0] : at[0]], ids[1][first[1] : at[1]]))
        return (groups, links) if at[1] == n[1] else None

    def solve(self, new: list[str]) -> Iterator[tuple]:
        """Of each piece (tokens of A, of B, groups, their text, linked pairs as 64-bit numbers), or () where the bytes differ."""
        own, names, (of_a, of_b) = self.encoder.lookup(set(new)), self.names, (self.a, self.b)
        other = self.sp.encode([GUARD + p for p in new], num_threads=1)
        for piece, b in zip(new, other, strict=True):
            a, guard, b, whole = array("I", own[piece]).tolist(), b[:2], b[2:], piece.encode()
            if guard != self.guard:
                yield piece, ()
            elif len(a) == 1 or len(b) == 1:  # one group, in which all is linked
                if not b"".join([of_a[i] for i in a]) == whole == b"".join([of_b[i] for i in b]):
                    yield piece, ()
                    continue
                text = ",".join([names[i] for i in a]) + "|" + ",".join([names[i] for i in b])
                yield piece, (len(a), len(b), 1, text, array("q", [(x << 32) | y for x in a for y in b]).tobytes())
            elif (found := self.align((a, b), whole)) is None:
                yield piece, ()
            else:
                groups, links = found
                text = ";".join([",".join([names[i] for i in x]) + "|" + ",".join([names[i] for i in y]) for x, y in groups])
                yield piece, (len(a), len(b), len(groups), text, array("q", [(x << 32) | y for x, y in links]).tobytes())

    def look_up(self, pieces) -> dict[str, tuple]:
        kept, found, new = self.kept, {}, []
        for p in pieces:
            got = kept.get(p)
            if got is None:
                new.append(p)
            else:
                found[p] = got
        for i in range(0, len(new), 5000):
            for piece, got in self.solve(new[i : i + 5000]):
                found[piece] = got
                if len(piece) <= KEPT_CHARS:
                    kept.put(piece, got)
        return found

    def document(self, portions: Iterator[tuple[list[str], dict[str, tuple]]]) -> tuple:
        """(tokens of A, of B, groups, digest, linked pairs, how often each) of a document's pieces."""
        import numpy as np

        digest, n, pairs, counts, sep = hashlib.sha256(), [0, 0, 0], [np.zeros(0, "<i8")], [np.zeros(0, "<i8")], ""
        for pieces, known in portions:
            got = [known[p] for p in pieces]
            if () in got:
                return 0, 0, 0, "", pairs[0], counts[0]
            for k in range(3):
                n[k] += sum([g[k] for g in got])
            digest.update((sep + ";".join([g[3] for g in got])).encode())
            sep = ";"
            times = Counter(pieces)
            own = [known[p][4] for p in times]
            pairs.append(np.frombuffer(b"".join(own), "<i8"))
            counts.append(np.repeat(np.fromiter(times.values(), "<i8", len(times)), [len(x) // 8 for x in own]))
            if len(pairs) > 64:
                pairs, counts = map(lambda x: [x], summed(pairs, counts))
        return (*n, digest.hexdigest() if sep else "", *summed(pairs, counts))

    def documents(self, texts: list[str]) -> Iterator[tuple]:
        for i, j in slices(list(map(len, texts))):
            cuts = [(COARSE if ODD(t) else FINE).finditer(" " + t) if t else iter(()) for t in texts[i:j]]
            if j - i == 1:
                yield self.document(self.long(cuts[0]))
                continue
            pieces = [[m[0] for m in c] for c in cuts]
            known = self.look_up(set().union(*pieces))
            for p in pieces:
                yield self.document(iter([(p, known)] if p else []))

    def long(self, cuts) -> Iterator[tuple[list[str], dict[str, tuple]]]:
        while pieces := [m[0] for m in islice(cuts, PORTION)]:
            yield pieces, self.look_up(set(pieces))


def summed(pairs: list, counts: list):
    import numpy as np

    keys, place = np.unique(np.concatenate(pairs), return_inverse=True)
    out = np.zeros(len(keys), "<i8")
    np.add.at(out, place, np.concatenate(counts))
    return keys, out


def aligner(path_a: str, path_b: str) -> Aligner:
    return worker_cache(("aligner", path_a, path_b), lambda: Aligner(path_a, path_b))


SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, times array<long>"


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """SCHEMA of docs(doc_id, text): counts, the digest of the groups, and the document's linked pairs (A's id * 2^32 + B's) with how often each."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        at = aligner(path_a, path_b)
        lists = lambda xs: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, xs)]), pa.int32()), pa.array(np.concatenate(xs)))
        for b in batches:
            ids, texts = column(b, "doc_id"), [t or "" for t in column(b, "text")]
            for i, j in slices(list(map(len, texts)), 4 << 20):
                rows = list(zip(*at.documents(texts[i:j]), strict=True))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
                flat = [pa.array(c, k) for c, k in zip(rows[:4], kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[i:j], pa.int64()), *flat, lists(rows[4]), lists(rows[5])], names=[x.split()[0] for x in SCHEMA.split(", ")])

    arrow_rows(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n, best): how many links hold each id pair, and whether none of its B id is held by more."""
    each = rows.select(F.explode(F.arrays_zip("pairs", "times")).alias("_p")).select("_p.pairs", "_p.times")
    total = each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("n"))
    most = F.max("n").over(Window.partitionBy(F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))))
    return total.select("pair", "n", (F.col("n") == most).alias("best"))


def alignment(docs: DataFrame, path_a: str, path_b: str, most: int = BROADCAST_PAIRS) -> DataFrame:
    """A row for each of docs(doc_id, text): n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    rows = keep(aligned(docs, path_a, path_b), "aligned")
    counts = keep(pair_counts(rows), "pairs")
    fields = ("doc_id", "n_a", "n_b", "n_groups", "groups_sha256")
    each = rows.withColumn("_row", F.monotonically_increasing_id()).select("_row", *fields, F.explode_outer(F.arrays_zip("pairs", "times")).alias("_p"))
    each = each.select("_row", *fields, F.col("_p.pairs").alias("pair"), F.col("_p.times").alias("times"))
    if counts.count() <= most:
        both = each.join(F.broadcast(counts), "pair", "left")
    else:
        salted = counts.withColumn("_s", F.explode(F.array(*map(F.lit, range(SALTS)))))
        both = each.withColumn("_s", F.pmod(F.xxhash64("_row"), F.lit(SALTS)).cast("int")).join(salted.hint("merge"), ["pair", "_s"], "left")
    got = both.groupBy("_row", *fields).agg(
        F.coalesce(F.sum("times"), F.lit(0)).alias("n_links"),
        F.coalesce(F.sum(F.when(F.col("best"), F.col("times"))), F.lit(0)).alias("n_best"),
        F.coalesce(F.sum(F.col("times") * F.col("n")), F.lit(0)).alias("count_sum"),
    )
    return got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_token_alignment(spark, sf_dir: str) -> DataFrame:
    """Alignment of a byte-level and a SentencePiece tokenizer over every document."""
    import public_tokenizers as public

    return alignment(spark.read.parquet(f"{sf_dir}/documents.parquet"), public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model"))
