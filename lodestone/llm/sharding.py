"""K-d tree sharding.

Documents are points in a space of metadata (size, place in the corpus, language). The tree
splits a node at the weighted median of its widest dimension, weights being bytes, until each
leaf holds its share: a node of n leaves gives its left child n // 2 of them and as large a
part of its bytes. The law is ``bytes``: sizes of shards are near equal.

Equal texts are one point, whatever else differs, so they stay in one shard. Only a text whose
copies outweigh a shard by themselves can't: it is dealt to several points of SPLIT of a shard,
which differ in nothing but their number, so that cuts may fall between them. There are fewer
such texts than shards, so their table may be broadcast.

Each level is one sort of the points by ranges over all partitions with running sums; the
driver sees only a row for each node and partition.

Defined cases: a null text has no bytes and counts as empty; null ids come first in a shard;
repeated rows get slots of their own; an empty table gives no rows. Missing metadata counts as 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import keep, ranged

OVERHEAD = 8
SPLIT = Fraction(1, 64)
DIMENSIONS = ("d_size", "d_place", "d_lang")
POINT = ("text_key", "text_crc32", "size", "share")


def metadata(docs: DataFrame) -> DataFrame:
    """One row without text for each document, written: read again on every level."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lang = F.coalesce(F.col("lang"), F.lit("")) if "lang" in docs.columns else F.lit("")
    code = F.ascii(lang) * 256 + F.ascii(F.substring(lang, 2, 1))
    return keep(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("text_key"),
            code.cast("double").alias("d_lang"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "shard-metadata",
    )


def points(meta: DataFrame, shards: int) -> tuple[DataFrame, DataFrame]:
    """(meta with ``share``, one weighted point for each text or share of a heavy text)."""
    total = meta.agg(F.sum("size")).first()[0] or 0
    fits, part = max(1, total // shards), max(1, int(total * SPLIT / shards))
    key = list(POINT[:3])
    group = meta.groupBy(*key).agg(F.sum("size").alias("w"), F.min("doc_id").alias("place"), F.min("d_lang").alias("lang"))
    heavy = group.where(F.col("w") > fits).withColumn("shares", F.ceil(F.col("w") / part)).drop("w")
    dealt = meta.join(F.broadcast(heavy), key, "left").withColumns({
        "share": F.pmod(F.xxhash64("row"), F.coalesce(F.col("shares"), F.lit(1))).cast("int"),
        "d_lang": F.coalesce("lang", "d_lang"), "place": F.coalesce("place", "doc_id", F.lit(0)).cast("double"),
    })
    made = dealt.groupBy(*POINT).agg(F.sum("size").alias("w"), F.min("place").alias("d_place"), F.min("d_lang").alias("d_lang"))
    return dealt, made.withColumns({"d_size": F.log2(F.col("size").cast("double")), "node": F.lit(0)})


def by_node(values: dict[int, Column]) -> Column:
    """values[node] as one expression; there is a node for each shard at most."""
    out = None
    for node, value in values.items():
        out = F.when(F.col("node") == node, value) if out is None else out.when(F.col("node") == node, value)
    return out


def running(batches: Iterator) -> Iterator:
    """Adds ``before``: the weight of the node's earlier points in this partition, whose rows are sorted by node."""
    import numpy as np
    import pyarrow as pa

    node, total = None, 0
    for b in batches:
        nodes, w = b.column("node").to_numpy(), b.column("w").to_numpy()
        before = np.zeros(len(w), np.int64)
        for n in np.unique(nodes):
            at = np.flatnonzero(nodes == n)
            if n != node:
                node, total = n, 0
            sums = total + np.cumsum(w[at])
            before[at] = sums - w[at]
            total = int(sums[-1])
        yield b.append_column("before", pa.array(before, pa.int64()))


def split(space: DataFrame, leaves: dict[int, int], held: DataFrame) -> tuple[DataFrame, dict[int, int], DataFrame]:
    """One level: every node of more than one leaf is cut in two. A node's number is that of its first leaf. held is the written table that space reads; the level's own takes its place."""
    stats = space.groupBy("node").agg(F.sum("w").alias("w"), *(f(d).alias(f"{n}_{d}") for d in DIMENSIONS for n, f in (("lo", F.min), ("hi", F.max)))).collect()
    width = {d: max([r[f"hi_{d}"] for r in stats]) - min([r[f"lo_{d}"] for r in stats]) or 1.0 for d in DIMENSIONS}
    widest, goal, grown = {}, {}, {}
    for r in stats:
        n = leaves[r["node"]]
        widest[r["node"]] = F.col(max(DIMENSIONS, key=lambda d: (r[f"hi_{d}"] - r[f"lo_{d}"]) / width[d]))  # noqa: B023
        goal[r["node"]] = F.lit(float(r["w"]) * (n // 2) / n)
        grown |= {r["node"]: n // 2, r["node"] + n // 2: n - n // 2} if n > 1 else {r["node"]: n}
    order = ("node", "v", *POINT)
    sorted_ = ranged(space.withColumn("v", by_node(widest)), *order).drop("at")
    fields = ", ".join(f"{n} {t}" for n, t in sorted_.dtypes)
    sorted_ = keep(sorted_.mapInArrow(running, f"{fields}, before long"), "shard-level", [held])
    first, start = [], dict.fromkeys(leaves, 0)
    for part, node, w in sorted(tuple(r) for r in sorted_.groupBy("part", "node").agg(F.sum("w")).collect()):
        first.append((part, node, start[node]))
        start[node] += w
    placed = sorted_.join(F.broadcast(space.sparkSession.createDataFrame(first, "part int, node int, first long")), ["part", "node"])
    middle = F.col("first") + F.col("before") + F.col("w") / 2
    half = by_node({node: F.lit(n // 2) for node, n in leaves.items()})
    single = F.col("node").isin([node for node, n in leaves.items() if n == 1])
    right = ~single & (middle >= by_node(goal))
    return placed.withColumn("node", F.when(right, F.col("node") + half).otherwise(F.col("node")).cast("int")).select(space.columns), grown, sorted_


def assign(docs: DataFrame, shards: int) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of docs(doc_id, text, and lang if there)."""
    meta = metadata(docs)
    dealt, space = points(meta, shards)
    space = held = keep(space, "shard-points")
    leaves = {0: shards}
    if space.isEmpty():
        return meta.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    while max(leaves.values()) > 1:
        space, leaves, held = split(space, leaves, held)
    found = dealt.select("doc_id", "row", *POINT).join(space.select(*POINT, F.col("node").alias("shard")), list(POINT))
    rows = keep(ranged(found.select("doc_id", "size", "text_crc32", "shard", "row"), "shard", "doc_id", "row"), "shards", [held, meta])
    first, start = [], {}
    for shard, part, at, n in sorted(tuple(r) for r in rows.groupBy("shard", "part").agg(F.min("at"), F.count("*")).collect()):
        first.append((shard, part, start.get(shard, 0) - at))
        start[shard] = start.get(shard, 0) + n
    first = docs.sparkSession.createDataFrame(first, "shard int, part int, move long")
    return rows.join(F.broadcast(first), ["shard", "part"]).select("doc_id", "size", "text_crc32", "shard", (F.col("at") + F.col("move")).alias("slot"))


def op2_kd_shards(spark, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal size."""
    rows = assign(spark.read.parquet(f"{sf_dir}/documents.parquet"), 24)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
