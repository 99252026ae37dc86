"""Near duplicates by a multi-index Hamming join of b-bit MinHash signatures.

A document's signature has MinHash values of 16 bits of its set of five-word shingles. It is
split into chunks of CHUNK positions. If two signatures of n chunks differ in at most 2 n - 1
positions, then by the pigeonhole principle they differ in at most one position of some chunk.
So each chunk is indexed once for each position left out; documents that share an index key
meet. Every pair that meets is confirmed on the full sets, unless the sizes of the sets, or of
their parts by hash (part_sizes), show that it can't link: these bounds lose nothing. The number of
chunks follows from the percentage that links (scheme): a pair at that resemblance meets
nowhere with a chance below MISSED. At 85 there are 8 chunks, at 80 there are 11.

Equal sets are one class before anything else. In a bucket (a key's documents) each one is first
compared with the two ends of the bucket, and links found so far are joined into components.
Buckets whose documents are all of one component are done. In the others

- documents of which too few shingles occur in any other document of such buckets are done: a
  link needs the percentage of a document's own shingles in the other one;
- documents outside the bucket's largest component are compared with all of the bucket, block
  by block within a task, which gives a spanning forest of the links. A block has BLOCK documents
  and about BLOCK_BYTES of sets.

A row of the largest component is copied once for each block of the others, and one of the
others once for each block of the bucket. So what is shuffled is in proportion to the rows as
long as a bucket's documents outside its largest component are a block or so; beyond that it
grows with their product over BLOCK. No pair is left out in any case.

Defined cases: a null or empty text has an empty set and is linked with nothing. A document of
fewer than five words has one shingle. Letters A-Z count as a-z. Rows that share an id are one
node. Rows with a null id get the component of their class, or null if it has no other id.
Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import arrow_rows, column, drop, keep, raw_texts, to_batches
from lodestone.llm.components import components

WORDS = 5
PERCENT = 85
CHUNK = 5
MISSED = 1e-6
BLOCK = 1024
BLOCK_BYTES = 32 << 20
PARTS = 128
SEED = 20_011
STEP = 4096  # shingles hashed at once


@dataclass(frozen=True)
class Scheme:
    """What finds the pairs that share percent of 100 shingles."""

    percent: int
    chunks: int

    @property
    def positions(self) -> int:
        return CHUNK * self.chunks


@cache
def scheme(percent: int) -> Scheme:
    """The fewest chunks with which a pair at the percentage meets nowhere with a chance below MISSED."""
    if not 0 < percent <= 100:
        raise ValueError(percent)
    p, q = percent / 100, 1 - percent / 100
    apart = 1 - p**CHUNK - CHUNK * q * p ** (CHUNK - 1)
    return Scheme(percent, next(n for n in count(1) if apart**n < MISSED))


def shingles(raw: bytes | None, size: int = WORDS):
    """Distinct 64-bit hashes of the shingles, ascending."""
    import numpy as np
    from xxhash import xxh3_64_intdigest

    words = raw.lower().split() if raw else []
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, n)
    k = min(size, n)
    h = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[j : n - k + 1 + j]
        h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return np.unique(h ^ (h >> np.uint64(29)))


def factors(positions: int):
    import numpy as np

    rng = np.random.default_rng(SEED)
    draw = lambda: rng.integers(0, 2**64, (positions, 1), np.uint64)
    return draw() | np.uint64(1), draw()


def signature(hashes, by) -> bytes:
    """16 bits of each position's smallest value."""
    import numpy as np

    a, b = by
    low = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), STEP):
        v = hashes[i : i + STEP] * a
        v += b
        low = np.minimum(low, v.min(1))
    return ((low * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(48)).astype("<u2").tobytes()


def part_sizes(hashes) -> bytes:
    """How many hashes have each value of their first bits; 255 stands for as many or more."""
    import numpy as np

    return np.minimum(np.bincount((hashes >> np.uint64(57)).astype(np.int64), minlength=PARTS), 255).astype(np.uint8).tobytes()


def may_link(x, y, n, m, percent: int):
    """Whether sets of sizes n and m with these part sizes can share the percentage: at most the smaller of each part is common."""
    import numpy as np

    common = np.minimum(x, y).sum(1, dtype=np.int64)
    full = ((x == 255) & (y == 255)).any(1)
    least, most = np.minimum(n, m), np.maximum(n, m)
    common = np.where(full, least, np.minimum(common, least))
    return (100 * common >= percent * (least + most - common)) & (100 * least >= percent * most)


def sketches(docs: DataFrame, by: Scheme) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, signature, parts): set_a and set_b are 128 bits that stand for the set."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        drawn = factors(by.positions)
        schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("signature", pa.binary()), ("parts", pa.binary())])

        def rows():
            for batch in batches:
                for d, raw in zip(column(batch, "doc_id"), raw_texts(batch), strict=True):
                    s = shingles(raw)
                    key = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                    ends = (int.from_bytes(key[i : i + 8], "little", signed=True) for i in (0, 8))
                    yield d, len(s), *ends, signature(s, drawn) if len(s) else None, part_sizes(s) if len(s) else None

        yield from to_batches(rows(), schema, 10_000)

    arrow_rows(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, signature binary, parts binary")


def index_keys(classes: DataFrame, by: Scheme) -> DataFrame:
    """(key, place, id): a key for each chunk and each of its positions left out; place is their number."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        chunks = by.chunks
        kept = np.array([[p for p in range(CHUNK) if p != m] for m in range(CHUNK)])
        tag = np.arange(chunks * CHUNK, dtype=np.uint64).reshape(chunks, CHUNK) + np.uint64(1)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            if not len(ids):
                continue
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2").reshape(len(ids), chunks, CHUNK).astype(np.uint64)
            h = tag * np.uint64(0x9E3779B97F4A7C15) + np.zeros((len(ids), chunks, CHUNK), np.uint64)
            for p in range(CHUNK - 1):
                h = (h ^ sig[:, :, kept[:, p]]) * np.uint64(0xD6E8FEB86659FD93)
                h ^= h >> np.uint64(31)
            keys = h.reshape(-1).view(np.int64)
            place = np.tile(np.arange(chunks * CHUNK, dtype=np.int32), len(ids))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(place), pa.array(np.repeat(ids, chunks * CHUNK))], names=["key", "place", "id"])

    return classes.select("id", "signature").mapInArrow(run, "key long, place int, id long")


def bytes_matrix(column, width: int):
    import numpy as np

    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def rather_near(pairs: DataFrame, by: Scheme) -> DataFrame:
    """(a, b) of pairs(a, b, parts_a, parts_b, n_a, n_b) that may link."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            x, y = (bytes_matrix(batch.column(i), PARTS) for i in (2, 3))
            good = may_link(x, y, batch.column(4).to_numpy(), batch.column(5).to_numpy(), by.percent)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return pairs.select("a", "b", "parts_a", "parts_b", "n_a", "n_b").mapInArrow(run, "a long, b long")


def alike(x, y, percent: int) -> bool:
    import numpy as np

    both = len(x) + len(y) - len(np.union1d(x, y))
    return 100 * both >= percent * (len(x) + len(y) - both)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs(a, b) whose full sets are alike."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            x, y = ([np.frombuffer(r, np.uint64) for r in column(batch, n)] for n in ("set_x", "set_y"))
            yield batch.select(["a", "b"]).filter(pa.array([alike(p, q, percent) for p, q in zip(x, y, strict=True)], pa.bool_()))

    held = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_x")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_y")), "b")
    return held.select("a", "b", "set_x", "set_y").mapInArrow(run, "a long, b long")


def full_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, set) of the documents of ids."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        schema = pa.schema([("id", pa.int64()), ("set", pa.binary())])
        rows = ((d, shingles(raw).tobytes()) for b in batches for d, raw in zip(column(b, "id"), raw_texts(b), strict=True))
        yield from to_batches(rows, schema, 500)

    return docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(ids, "id", "left_semi").mapInArrow(run, "id long, set binary")


def set_tokens(sets: DataFrame) -> DataFrame:
    """(id, shingle) of sets(id, set)."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for i, raw in zip(column(batch, "id"), column(batch, "set"), strict=True):
                for at in range(0, len(raw), 8 * 50_000):
                    v = np.frombuffer(raw[at : at + 8 * 50_000], np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), i, np.int64)), pa.array(v)], names=["id", "shingle"])

    return sets.select("id", "set").mapInArrow(run, "id long, shingle long")


def without_partner(sets: DataFrame, percent: int) -> DataFrame:
    """(id) of the sets that share too few shingles with all others together to link with any. Shingles are counted before the shuffle; no join on them."""
    lone = set_tokens(sets).groupBy("shingle").agg(F.count("*").alias("c"), F.max("id").alias("id")).where("c = 1")
    lone = lone.groupBy("id").agg(F.count("*").alias("lone"))
    return lone.join(sets.select("id", F.expr("octet_length(set) div 8").alias("n")), "id").where(F.col("n") * percent > (F.col("n") - F.col("lone")) * 100).select("id")


@dataclass
class Cell:
    """The rows of one block of the others against one block of the bucket."""

    table: object
    by: Scheme

    def __post_init__(self) -> None:
        import numpy as np

        col = self.table.column
        self.ids, self.n, self.label = (np.array(col(c).to_pylist()) for c in ("id", "n", "label"))
        self.signature = np.frombuffer(b"".join(col("signature").to_pylist()), "<u2").reshape(-1, self.by.chunks, CHUNK)
        self.parts = bytes_matrix(col("parts"), PARTS)
        at = {c: col(c)[0].as_py() for c in ("i", "j", "place")}
        self.key = (at["place"] // CHUNK, at["place"] % CHUNK)
        other = np.array(col("other").to_pylist(), bool)
        self.left = np.flatnonzero(other & (np.array(col("other_block").to_pylist()) == at["j"]))
        self.right = np.array(col("block").to_pylist()) == at["i"]
        self.other = other

    def open_pairs(self) -> list[tuple[int, int]]:
        """Rows (x, y) of pairs that are still to be compared, nearest first.

        Pairs of one component are settled. A pair of two others meets in two cells; it is compared
        where the smaller id is on the left. A pair that shares several keys is compared at the
        first of them only; that key's bucket has both components too, so it is compared there.
        """
        import numpy as np

        out = []
        for x in self.left:
            ok = self.right & (self.label != self.label[x]) & ~(self.other & (self.ids <= self.ids[x]))
            y = np.flatnonzero(ok)
            y = y[may_link(self.parts[y], self.parts[x], self.n[y], self.n[x], self.by.percent)]
            same = self.signature[y] == self.signature[x]
            counts = same.sum(2)
            for k, c in enumerate(np.argmax(counts >= CHUNK - 1, 1)):
                m = 0 if counts[k, c] == CHUNK else int(np.argmin(same[k, c]))
                if (int(c), m) == self.key:
                    out.append((-int(same[k].sum()), int(x), int(y[k])))
        out.sort()
        return [(x, y) for _, x, y in out]


def still_open(table, by: Scheme):
    """The rows of a cell that are in a pair still to be compared."""
    import pyarrow as pa

    wanted = sorted({x for p in Cell(table, by).open_pairs() for x in p})
    return table.take(pa.array(wanted, pa.int64()))


def cell_links(table, by: Scheme):
    """A spanning forest of the links between the components of a cell."""
    import numpy as np
    import pyarrow as pa

    cell = Cell(table, by)
    sets = [np.frombuffer(x, np.uint64) for x in table.column("set").to_pylist()]
    root = {int(x): int(x) for x in cell.label}

    def top(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    a, b = [], []
    for i, j in cell.open_pairs():
        x, y = top(int(cell.label[i])), top(int(cell.label[j]))
        if x != y and alike(sets[i], sets[j], by.percent):
            root[max(x, y)] = min(x, y)
            a.append(int(cell.ids[i]))
            b.append(int(cell.ids[j]))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def mixed(marked: DataFrame) -> DataFrame:
    """The rows(key, place, id, label) of buckets with several components."""
    several = marked.groupBy("key", "place").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l < h").select("key", "place")
    return marked.join(several, ["key", "place"])


def dealt(rows: DataFrame) -> DataFrame:
    """rows(key, place, id, label, n) dealt to cells (i, j) of their bucket: those outside the largest component by blocks j, all by blocks i."""
    blocks = lambda n, size: F.ceil(F.greatest(n / BLOCK, 8 * size / BLOCK_BYTES)).cast("int")
    parts = rows.groupBy("key", "place", "label").agg(F.count("*").alias("c"), F.sum("n").alias("size"))
    largest = F.max(F.struct("c", "size", "label"))
    sizes = parts.groupBy("key", "place").agg(largest.alias("top"), F.sum("c").alias("c"), F.sum("size").alias("size"))
    cut = sizes.select("key", "place", F.col("top.label").alias("most"), blocks(F.col("c"), F.col("size")).alias("blocks"), blocks(F.col("c") - F.col("top.c"), F.col("size") - F.col("top.size")).alias("other_blocks"))
    held = rows.join(cut, ["key", "place"])
    h = F.xxhash64("id")
    held = held.withColumns({"other": F.col("label") != F.col("most"), "block": F.pmod(h, "blocks").cast("int"), "other_block": F.pmod(h, "other_blocks").cast("int")})
    all_of = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    across = F.transform(all_of("other_blocks"), lambda j: F.struct(F.col("block").alias("i"), j.alias("j")))
    down = F.transform(all_of("blocks"), lambda i: F.struct(i.alias("i"), F.col("other_block").alias("j")))
    cells = F.when(F.col("other"), F.array_distinct(F.concat(across, down))).otherwise(across)
    held = held.withColumn("cell", F.explode_outer(cells))
    return held.select("key", "place", F.col("cell.i").alias("i"), F.col("cell.j").alias("j"), "id", "label", "other", "block", "other_block")


def rest_links(members: DataFrame, nodes: DataFrame, sets: DataFrame, labels: DataFrame, by: Scheme) -> DataFrame:
    """Links between components within buckets of four or more documents, but for their ends."""
    inner = members.where((F.col("n") >= 4) & (F.col("id") != F.col("lo")) & (F.col("id") != F.col("hi"))).select("key", "place", "id")
    open_rows = keep(mixed(inner.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))), "open-rows")
    whole = keep(mixed(members.where("n >= 4").select("key", "place", "id").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))).select("id").distinct(), "open-ids")
    done = without_partner(sets.join(whole, "id", "left_semi"), by.percent)
    about = nodes.select("id", "signature", "parts", F.col("n_shingles").alias("n"))
    left = mixed(open_rows.join(done, "id", "left_anti")).join(about.select("id", "n"), "id")
    cells = dealt(keep(left, "left-rows", [whole, open_rows])).join(about, "id")
    fields = "id long, key long, place int, i int, j int, block int, other_block int, other boolean, label long, signature binary, parts binary, n long"
    cells = cells.select(*(x.split()[0] for x in fields.split(", ")))
    found = keep(cells.groupBy("key", "place", "i", "j").applyInArrow(lambda t: still_open(t, by), fields), "open-pairs")
    return keep(found.join(sets, "id").groupBy("key", "place", "i", "j").applyInArrow(lambda t: cell_links(t, by), "a long, b long"), "more-links", [found])


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document; links are between those that share percent of 100 shingles or more."""
    way = scheme(percent)
    rows = keep(sketches(docs, way), "sketches")
    by = ["set_a", "set_b", "n_shingles"]
    classes = keep(rows.where("n_shingles > 0").groupBy(*by).agg(F.min("doc_id").alias("id"), F.min("signature").alias("signature"), F.min("parts").alias("parts")), "classes")
    nodes = classes.where("id IS NOT NULL")
    keys = index_keys(nodes, way)
    buckets = keys.groupBy("key", "place").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n")).where("lo < hi")
    members = keep(keys.join(buckets, ["key", "place"]), "members")
    ends = members.select("id", F.explode(F.array("lo", "hi")).alias("end")).where("id <> end").select(F.greatest("id", "end").alias("a"), F.least("id", "end").alias("b")).distinct()
    about = nodes.select("id", "parts", "n_shingles")
    for side in ("a", "b"):
        ends = ends.join(about.toDF(side, f"parts_{side}", f"n_{side}"), side)
    pairs = keep(rather_near(ends, way), "pairs")
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).union(members.where("n >= 4").select("id")).distinct()
    sets = keep(full_sets(docs, ids), "sets")
    links = keep(confirmed(pairs, sets, percent), "links", [pairs])
    first = components(links)
    more = rest_links(members, nodes, sets, first, way)
    labels = components(links.union(more))
    drop(members, sets, links, first, more)
    found = classes.join(labels, "id", "left").select(*by, F.coalesce("label", "id").alias("class_id"))
    out = rows.drop("signature", "parts").join(found, by, "left")
    component = F.when(F.col("n_shingles") > 0, F.col("class_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    return keep(out, "near", [rows, classes, labels])


def op4_hamming_minhash(spark, sf_dir: str) -> DataFrame:
    """Components of documents that share 85 of 100 shingles or more."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), PERCENT)
