"""Token ids on disk as directly addressable codes.

An id is split into chunks of 8 bits, lowest first. Level k holds the k-th chunks of all ids
that have one, a bitmap that says which of them continue on the next level, and a rank
directory: the number of set bits before each block of 512. The place of an id's chunk on the
next level is the rank of its bit, so any token is read without decoding others.

A corpus is a table of segments in ascending document order. Each holds whole documents:
their ids and lengths, the token offset in its part, and the coded tokens as one binary. Spark
writes and commits the files, so they may be in any store, and a lost task leaves nothing behind.

Layout of a payload, little-endian: magic ``DAC1``, levels (u8), then for each level: codes
(u64), the codes (u8 each), the bitmap (lowest bit first), the rank directory (u32 each).

Defined cases: a null or empty text is a document of the end id alone. Documents with equal
ids stay in the order of their texts; null ids come first. A document longer than a segment
gets a segment of its own.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import arrow_rows, column, keep, ranged, running_start, to_batches
from lodestone.llm.encoding import encoder

MAGIC = b"DAC1"
BLOCK = 512
SEGMENT_TOKENS = 1 << 19
END_ID = 2


def pack_ids(ids) -> bytes:
    """Coded form of an array of unsigned 32-bit ids."""
    import numpy as np

    levels, v = [], np.asarray(ids, np.uint32)
    while len(v) or not levels:
        rest = v >> 8
        more = rest > 0
        bits = np.packbits(more, bitorder="little")
        ones = np.add.reduceat(more.astype(np.uint32), np.arange(0, len(v), BLOCK)) if len(v) else np.zeros(0, np.uint32)
        rank = (np.cumsum(ones) - ones).astype("<u4")
        levels.append(struct.pack("<Q", len(v)) + (v & 0xFF).astype(np.uint8).tobytes() + bits.tobytes() + rank.tobytes())
        v = rest[more]
    return MAGIC + struct.pack("<B", len(levels)) + b"".join(levels)


@dataclass(frozen=True)
class Level:
    codes: object
    bits: object
    rank: object

    def follows(self, i: int) -> bool:
        return bool(self.bits[i >> 3] >> (i & 7) & 1)

    def before(self, i: int) -> int:
        """Set bits before place i: one entry of the directory and less than a block of the bitmap."""
        import numpy as np

        start = i // BLOCK * BLOCK
        part = np.unpackbits(self.bits[start >> 3 : (i >> 3) + 1], bitorder="little")[: i - start]
        return int(self.rank[i // BLOCK]) + int(part.sum())


class Codes:
    """Reads a payload: any token by its place, or all of them."""

    def __init__(self, payload: bytes) -> None:
        import numpy as np

        if payload[:4] != MAGIC:
            raise ValueError("not a payload of directly addressable codes")
        self.levels, at = [], 5
        for _ in range(payload[4]):
            (n,) = struct.unpack_from("<Q", payload, at)
            sizes, kinds, parts = (n, (n + 7) // 8, (n + BLOCK - 1) // BLOCK), (np.uint8, np.uint8, "<u4"), []
            at += 8
            for size, kind in zip(sizes, kinds, strict=True):
                parts.append(np.frombuffer(payload, kind, size, at))
                at += size * np.dtype(kind).itemsize
            self.levels.append(Level(*parts))

    def __len__(self) -> int:
        return len(self.levels[0].codes)

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = 0
        for k, level in enumerate(self.levels):
            value |= int(level.codes[i]) << 8 * k
            if not level.follows(i):
                break
            i = level.before(i)
        return value

    def all(self):
        import numpy as np

        v = np.zeros(0, np.uint32)
        for level in reversed(self.levels):
            more = np.unpackbits(level.bits, count=len(level.codes), bitorder="little").astype(bool)
            here = level.codes.astype(np.uint32)
            here[more] |= v << 8
            v = here
        return v


SEGMENT = "part int, segment int, start long, doc_ids array<long>, lengths array<long>, payload binary"


def segments(docs: DataFrame, tokenizer: str, end_id: int = END_ID, segment_tokens: int = SEGMENT_TOKENS) -> DataFrame:
    """SEGMENT rows of docs(doc_id, text), in ascending order of the ids. The only shuffle deals the texts out by ranges of the id."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        schema = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("start", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("payload", pa.binary())])
        end = struct.pack("<I", end_id)
        state = {"part": 0, "segment": 0, "start": 0}
        ids: list = []
        held: list[bytes] = []

        def emit():
            raw = b"".join(held)
            row = (state["part"], state["segment"], state["start"], list(ids), [len(x) // 4 for x in held], pack_ids(np.frombuffer(raw, "<u4")))
            state["segment"] += 1
            state["start"] += len(raw) // 4
            ids.clear()
            held.clear()
            return row

        def rows():
            size = 0
            for b in batches:
                if b.num_rows:
                    state["part"] = b.column(2)[0].as_py()
                for d, x in zip(column(b, "doc_id"), encoder(tokenizer).encode([t or "" for t in column(b, "text")]), strict=True):
                    ids.append(d)
                    held.append(x + end)
                    size += len(held[-1]) // 4
                    if size >= segment_tokens:
                        yield emit()
                        size = 0
            if ids:
                yield emit()

        yield from to_batches(rows(), schema, 4)

    arrow_rows(docs.sparkSession)
    rows = ranged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", ties=("text",))
    return rows.select("doc_id", "text", "part").mapInArrow(run, SEGMENT)


def read_documents(table: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from a table of segments; start counts the tokens of all documents before."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

        def rows():
            for b in batches:
                for start, ids, lengths, payload in zip(column(b, "start"), column(b, "doc_ids"), column(b, "lengths"), column(b, "payload"), strict=True):
                    raw, at = Codes(payload).all().astype("<u4").tobytes(), 0
                    for d, n in zip(ids, lengths, strict=True):
                        yield d, start + at, n, zlib.crc32(raw[4 * at : 4 * (at + n)])
                        at += n

        yield from to_batches(rows(), schema, 10_000)

    sizes = table.groupBy("part").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    first = running_start(sizes, "n").withColumnRenamed("start", "first")  # one row for each part
    spark = table.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    placed = table.join(F.broadcast(first), "part")
    return placed.select((F.col("first") + F.col("start")).alias("start"), "doc_ids", "lengths", "payload").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_tokens(table: DataFrame, doc_id: int, start: int, stop: int) -> list[int]:
    """Some tokens of one document, without decoding others."""
    row = table.where(F.array_contains("doc_ids", F.lit(doc_id).cast("long"))).select("doc_ids", "lengths", "payload").first()
    if row is None:
        return []
    k = row["doc_ids"].index(doc_id)
    at, codes = sum(islice(row["lengths"], k)), Codes(bytes(row["payload"]))
    return [codes[at + i] for i in range(max(0, start), min(stop, row["lengths"][k]))]


def op3_token_codes(spark, sf_dir: str) -> DataFrame:
    """Writes the ids of every document, and returns what the files hold."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_documents(keep(segments(docs, public_tokenizers.path("word_bpe_49k.json")), "tokens"))
