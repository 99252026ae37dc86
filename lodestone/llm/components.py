"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import keep


def forest(links: DataFrame) -> DataFrame:
    """As many components from fewer links: each task keeps a star for each component of its own links. Its memory is bounded by its part of the links."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        root: dict[int, int] = {}

        def top(x: int) -> int:
            at = x
            while root.setdefault(at, at) != at:
                at = root[at]
            while root[x] != at:
                root[x], x = at, root[x]
            return at

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = top(a), top(b)
                if a != b:
                    root[max(a, b)] = min(a, b)
        found = [(x, top(x)) for x in root]
        found = [x for x in found if x[0] != x[1]]
        for i in range(0, len(found), 50_000):
            a, b = zip(*found[i : i + 50_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return links.mapInArrow(run, "a long, b long")


def star(links: DataFrame, large: bool) -> DataFrame:
    """Links every node to the smallest of its neighbourhood: of nodes above it (large), or of those below with itself (small)."""
    both = links.union(links.select("b", "a")) if large else links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    tied = both.join(least, "a")
    if large:
        out = tied.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = tied.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, label) of every node of links(a long, b long): the smallest id that it reaches.

    Alternating stars: the number of rounds grows as the logarithm of the number of nodes, each
    writes its links to the shared folder, and a round never has more links than the first. An
    empty table has no components; nulls are left out.
    """
    links = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    links, before = keep(forest(links), "links"), None
    while True:
        now = tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == before or not now[0]:
            break
        before = now
        links = keep(star(star(links, large=True), large=False), "links", [links])
    found = links.select(F.col("a").alias("id"), F.col("b").alias("label")).union(links.select(F.col("b").alias("id"), F.col("b").alias("label")).distinct())
    return keep(found, "components", [links])
