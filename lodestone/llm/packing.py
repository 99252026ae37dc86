"""Best-two-fit packing of documents into sequences.

A sequence is filled greedily with the longest pieces that fit. Then its smallest piece is
exchanged for two unpacked pieces that fill the gap, widened by that piece, more tightly, as
long as such a pair exists.

Pieces are dealt evenly to groups of about GROUP_TOKENS tokens, which are packed
independently: memory of a task is bounded, and all groups together lose about one sequence
for each group against packing everything at once.

Defined cases: a null or empty text is a document of the end id alone. A document longer than
the sequence is cut into pieces of full length, of which the first takes the remainder.
Repeated rows are packed as documents of their own.
"""

from __future__ import annotations

import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import arrow_rows, column, keep, to_batches
from lodestone.llm.encoding import encoder

SEQUENCE = 2048
GROUP_TOKENS = 4 << 20
END_ID = 0

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; the first takes the remainder."""
    first = n % size or size
    return [(0, min(n, first)), *((i, size) for i in range(first, n, size))]


def pieces(docs: DataFrame, tokenizer: str, end_id: int = END_ID, size: int = SEQUENCE) -> DataFrame:
    """PIECE rows of docs(doc_id, text). No shuffle."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
        end = struct.pack("<I", end_id)

        def rows():
            for b in batches:
                for d, x in zip(column(b, "doc_id"), encoder(tokenizer).encode([t or "" for t in column(b, "text")]), strict=True):
                    raw = x + end
                    for k, (start, n) in enumerate(cut(len(raw) // 4, size)):
                        yield d, k, start, n, zlib.crc32(raw[4 * start : 4 * (start + n)])

        yield from to_batches(rows(), schema, 10_000)

    arrow_rows(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECE)


class Lengths:
    """Unpacked pieces by length; a bit for each length that is left."""

    def __init__(self, lengths) -> None:
        self.left: dict[int, list[int]] = defaultdict(list)
        self.mask = 0
        for i, n in enumerate(lengths):
            self.put(n, i)

    def put(self, n: int, i: int) -> None:
        self.left[n].append(i)
        self.mask |= 1 << n

    def take(self, n: int) -> int:
        i = self.left[n].pop()
        if not self.left[n]:
            self.mask ^= 1 << n
        return i

    def fit(self, room: int) -> int:
        """The greatest length left that fits, or 0."""
        return max(0, (self.mask & ((2 << room) - 1)).bit_length() - 1)

    def two(self, room: int, above: int) -> tuple[int, int] | None:
        """The two lengths left that fill most of the room, and more than above."""
        best, pair, a = above, None, self.fit(room)
        while a and 2 * a > best:
            b = self.fit(min(a, room - a))
            if b == a and len(self.left[a]) < 2:
                b = self.fit(a - 1)
            if b and a + b > best:
                best, pair = a + b, (a, b)
                if best == room:
                    break
            a = self.fit(a - 1)
        return pair


def best_two_fit(lengths, size: int = SEQUENCE) -> list[list[int]]:
    """Sequences as lists of places in lengths. Each length is between 1 and size."""
    left, out = Lengths(lengths), []
    while left.mask:
        gap, held = size, []
        while n := left.fit(gap):
            held.append((n, left.take(n)))
            gap -= n
        while gap:
            held.sort(reverse=True)
            least = held[-1][0]
            if not (pair := left.two(gap + least, least)):
                break
            left.put(*held.pop())
            held += [(n, left.take(n)) for n in pair]
            gap += least - sum(pair)
        out.append([i for _, i in held])
    return out


def pack(rows: DataFrame, size: int = SEQUENCE, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Rows with a length, plus (sequence_id, offset). rows should be a written table: it is read twice."""
    total = rows.agg(F.sum("length")).first()[0] or 0
    groups = max(1, round(total / group_tokens))

    def run(table):
        import pyarrow as pa

        lengths = table.column("length").to_pylist()
        sequence, offset = [0] * len(lengths), [0] * len(lengths)
        base = table.column("_group")[0].as_py() << 32
        for k, held in enumerate(best_two_fit(lengths, size)):
            at = 0
            for i in held:
                sequence[i], offset[i] = base + k, at
                at += lengths[i]
        return table.drop_columns("_group").append_column("sequence_id", pa.array(sequence, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    dealt = rows.withColumn("_group", F.pmod(F.monotonically_increasing_id(), F.lit(groups)).cast("int"))
    fields = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return dealt.groupBy("_group").applyInArrow(run, f"{fields}, sequence_id long, offset long")


def op8_best_two_fit(spark, sf_dir: str) -> DataFrame:
    """Every document in sequences of at most 2048 tokens."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(keep(pieces(docs, public_tokenizers.path("byte_bpe_50k.json")), "pieces"))
