"""Bottom-k sketches of word shingles, in DataFrame functions only.

The sketch of a text is the K smallest distinct 64-bit hashes of its five-word shingles, as a
sorted array. Sketches of parts merge into the sketch of the whole. Two sketches estimate
resemblance and containment, one the number of distinct shingles.

Defined cases: a null text counts as empty and has an empty sketch; a text of fewer than five
words has one shingle, all its words. Two empty sketches resemble each other fully, an empty
one and another not at all. Letters are compared in lower case. Rows that share an id stay
apart, in the order of a hash of their texts; null ids come first. An empty table gives none.
Texts of any length are taken whole. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import partitions, ranged

K = 64
WORDS = 5
#: Rows of one run of neighbours.
RUN = 1024
#: Runs for each partition at most.
RUNS = 16


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def shingle_hashes(w: Column, size: int = WORDS) -> Column:
    """Hashes of the shingles of an array of words, which should be a column: it is read once for each word."""
    each = F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(size))))
    return F.when(F.size(w) >= size, each).when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<long>"))


def bottom(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def with_sketch(df: DataFrame, text: str, name: str, k: int = K) -> DataFrame:
    """df with the sketch of a text column."""
    held = f"_words_{name}"
    return df.withColumn(held, words(F.col(text))).withColumn(name, bottom(shingle_hashes(F.col(held)), k)).drop(held)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both texts together."""
    return bottom(F.concat(a, b), k)


def merge_rows(df: DataFrame, keys: list[str], sketch: str = "sketch", k: int = K) -> DataFrame:
    """One sketch for each key: the k smallest hashes of all its rows. Each task keeps k hashes of a key before the shuffle, so no group is gathered."""
    hashes = df.select(*keys, F.explode(sketch).alias("_h")).distinct()
    least = hashes.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("_h"))).where(F.col("_n") <= k)
    return least.groupBy(*keys).agg(F.sort_array(F.collect_list("_h")).alias(sketch))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of the shared part of both sets: of the k smallest hashes of the union, those in both."""
    union = merge(a, b, k)
    shared = F.size(F.array_intersect(F.array_intersect(union, a), b))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(shared / F.size(union))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of the part of a's set that is in b's."""
    of_a = F.array_intersect(merge(a, b, k), a)
    return F.when(F.size(of_a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(of_a, b)) / F.size(of_a))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimate of the number of distinct shingles; exact below k."""
    share = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def as_text(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def place(key: str, text: str) -> Column:
    """What rows are ordered by: null keys first, then the key, then a hash of the text."""
    return F.struct(F.col(key).isNotNull().cast("int").alias("f"), F.coalesce(key, F.lit(0).cast("long")).alias("k"), F.xxhash64(text).alias("h"))


def run_starts(rows: DataFrame, key: str, text: str, size: int) -> list[tuple[int, int, int]]:
    """Places at which runs of ``size`` rows begin, ascending; the first is the least of all.

    The ids alone are sorted by range. A run has more rows where that keeps the number of runs
    below RUNS for each partition, so what comes to the driver is bounded by their number; it has
    more rows, too, where more of them have the same id and text.
    """
    parts = partitions(rows.sparkSession)
    places = ranged(rows.select(place(key, text).alias("p")).select("p.*"), "f", "k", "h")
    step = max(size, -(-rows.count() // (RUNS * parts)))
    return sorted(set(map(tuple, places.where(F.col("at") % step == 0).select("f", "k", "h").collect())))


def run_of(starts: list[tuple[int, int, int]], at: Column) -> Column:
    """Number of the last run that begins at or before a place, by bisection."""
    bounds = F.from_json(F.lit(json.dumps([{"f": f, "k": k, "h": h} for f, k, h in starts])), "array<struct<f:int,k:bigint,h:bigint>>")

    def step(a: Column, _: Column) -> Column:
        mid = F.floor((a["lo"] + a["hi"]) / 2).cast("int")
        below = F.get(bounds, mid) <= at
        return F.struct(F.when(below, mid).otherwise(a["lo"]).alias("lo"), F.when(below, a["hi"]).otherwise(mid).alias("hi"))

    ends = F.struct(F.lit(0).alias("lo"), F.lit(max(1, len(starts))).alias("hi"))
    steps = max(1, len(starts)).bit_length()
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), ends, step, lambda a: a["lo"])


def with_next(rows: DataFrame, key: str, text: str, sketch: str, size: int = RUN) -> DataFrame:
    """rows(key, text), no text null, with their sketch, and ``next_text`` and ``next_sketch`` of the row behind in ascending order of (key, hash of the text, text); behind the last comes the first.

    Rows are dealt out by runs of neighbours and look ahead within their run: one shuffle of the
    texts. Each run ends with a copy of the row that begins the next one. Nothing is computed
    with the keys, so they may be any 64-bit integers.
    """
    starts = run_starts(rows, key, text, size)
    runs, parts = max(1, len(starts)), partitions(rows.sparkSession)
    numbered = rows.sparkSession.createDataFrame([(*s, i) for i, s in enumerate(starts)], "f int, k long, h long, _run int")
    at = rows.select(key, text, place(key, text).alias("_at"))
    heads = at.select(key, text, "_at", F.col("_at.f").alias("f"), F.col("_at.k").alias("k"), F.col("_at.h").alias("h")).join(F.broadcast(numbered), ["f", "k", "h"])
    heads = heads.groupBy("_run").agg(F.min(F.struct(F.col(text), F.col(key))).alias("_row"), F.first("_at").alias("_at"))
    before = F.pmod(F.col("_run") - 1, F.lit(runs)).cast("int")
    guards = heads.select(F.col(f"_row.{key}").alias(key), F.col(f"_row.{text}").alias(text), "_at", before.alias("_run"), F.lit(1).alias("_guard"))
    held = at.withColumns({"_run": run_of(starts, F.col("_at")).cast("int"), "_guard": F.lit(0)}).unionByName(guards)
    share = F.floor(F.col("_run").cast("long") * min(parts, runs) / runs).cast("int")
    held = held.withColumn("_part", share).repartitionById(min(parts, runs), F.col("_part"))
    order = Window.partitionBy("_part", "_run").orderBy("_guard", "_at", text)
    out = with_sketch(held, text, sketch).withColumn("_next", F.lead(F.struct(text, sketch)).over(order)).where("_guard = 0")
    return out.select(key, text, sketch, F.col("_next")[text].alias("next_text"), F.col("_next")[sketch].alias("next_sketch"))


def edited_text(rows: DataFrame) -> DataFrame:
    """The last half of the text replaced by as much of the next text's beginning."""
    n = F.length("text")
    return rows.withColumn("n_chars", n.cast("long")).withColumn("_half", F.floor(n / 2).cast("int")).withColumn(
        "edited_text", F.concat(F.substring("text", F.lit(1), F.length("text") - F.col("_half")), F.substring("next_text", F.lit(1), F.col("_half")))
    ).drop("_half")


def op5_bottom_k(spark, sf_dir: str) -> DataFrame:
    """Sketches of every text, of its edited form, and their likeness to each other and to the next text's."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = with_sketch(edited_text(with_next(rows, "doc_id", "text", "sketch")), "edited_text", "edited_sketch")
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"), as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        distinct_shingles(F.col("sketch")).alias("n_shingles_estimate"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("contained_in_edited"),
    )
