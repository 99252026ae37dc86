"""Retrieval for whole batches of questions: vectors, structured lines, and what joins the agents' hits.

A hit has query_id, id, score, rank, source fields, and the agent's name. Status rows tell for
each question how an agent did. Lexical search is ``lexicon``'s.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.settings import Settings

#: Vectors and questions that meet in a cell, and questions that are multiplied at once.
CELL_VECTORS, CELL_QUERIES, TOGETHER = 32_768, 8_192, 128
TOKEN = r"[\p{L}0-9]+"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term), distinct."""
    return queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("term"))


def ranked(hits: DataFrame, k: int, by: list[str], score: str = "score", key: str = "id") -> DataFrame:
    """The k best of each group, with their rank; ties by id. Spark limits each task's rows before the shuffle."""
    order = Window.partitionBy(*by).orderBy(F.desc(score), F.asc(key))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two float arrays; null if one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def cells(vectors: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score): of each cell the k best of its vectors(id, embedding[, list]) for each of its asked(query_id, embedding[, lists]), by cosine.

    Both are dealt by key; every part of the questions meets every part of the vectors, CELL_QUERIES
    by CELL_VECTORS at most in expectation, as products of matrices. With lists, which are the bits of
    an array of longs, a question meets the vectors of those lists only. Rows without a length are left out. The numbers of a cell are of one
    type on both sides, since Spark deals an int and a long of the same value to different tasks;
    cells are dealt by their number, since their bytes don't tell what their product takes.
    """
    many, few = (max(1, -(-df.count() // n)) for df, n in ((vectors, CELL_VECTORS), (asked, CELL_QUERIES)))
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((asked, "query_id"), (vectors, "id"))]
    listed = "lists" in asked.columns
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda df: df.repartition(many * few, "_v", "_a").groupBy("_v", "_a")
    left = dealt(vectors.withColumns({"_v": part("id", many), "_a": every(few)}))
    right = dealt(asked.withColumns({"_v": every(many), "_a": part("query_id", few)}))

    def run(v, q):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        schema = pa.schema([("query_id", q.schema.field("query_id").type), ("id", v.schema.field("id").type), ("score", pa.float64())])
        if not len(v) or not len(q):
            return schema.empty_table()
        v = v.take(pc.sort_indices(v, [("id", "ascending")]))
        (held, a), (wanted, b) = unit_rows(v["embedding"]), unit_rows(q["embedding"])
        if not len(held) or not len(wanted):
            return schema.empty_table()
        if listed:
            of = v["list"].to_numpy()[held]
            bits = q["lists"].combine_chunks().flatten().to_numpy().view("u8").reshape(len(q), -1)[wanted]
        at, near, said = [], [], []
        for low in range(0, len(wanted), TOGETHER):
            score = b[low : low + TOGETHER] @ a.T
            if listed:
                score[bits[low : low + TOGETHER, of >> 6] >> (of & 63).astype("u8") & np.uint64(1) == 0] = -np.inf
            # whatever rounds to the k-th best score stays, so that the order by id is the whole's
            least = np.partition(score, -k, axis=1)[:, -k] - 2e-9 if score.shape[1] > k else np.full(len(score), -2.0)
            i, j = np.nonzero((score >= least[:, None]) & (score > -np.inf))
            s = np.round(score[i, j], 9)
            order = np.lexsort((j, -s, i))
            i, j, s = i[order], j[order], s[order]
            kept = np.arange(len(i)) - np.searchsorted(i, i) < k
            at.append(wanted[i[kept] + low]), near.append(held[j[kept]]), said.append(s[kept])
        at, near, said = map(np.concatenate, (at, near, said))
        return pa.Table.from_arrays([q["query_id"].take(pa.array(at)), v["id"].take(pa.array(near)), pa.array(said)], schema=schema)

    return left.cogroup(right).applyInArrow(run, f"query_id {kinds[0]}, id {kinds[1]}, score double")


def unit_rows(values):
    """(row numbers, unit vectors) of an Arrow list column: those that have a length."""
    import numpy as np

    values = values.combine_chunks() if hasattr(values, "combine_chunks") else values
    sizes = set(values.value_lengths().to_pylist())
    if values.null_count == 0 and len(sizes) == 1 and (flat := values.flatten()).null_count == 0:
        rows, m = np.arange(len(values)), flat.to_numpy().astype("f8").reshape(len(values), -1)
    else:
        held = [(i, x) for i, x in enumerate(values.to_pylist()) if x and all(y is not None for y in x)]
        if not held:
            return np.zeros(0, "i8"), np.zeros((0, 0))
        rows, m = np.array([i for i, _ in held], "i8"), np.array([x for _, x in held], "f8").reshape(len(held), -1)
    size = np.sqrt((m * m).sum(1))
    good = size > 0
    return rows[good], m[good] / size[good, None]


def vector(vectors: DataFrame, queries: DataFrame, k: int | None = None, settings: Settings = Settings(), key: str = "id") -> DataFrame:
    """Top vectors of each question by cosine. queries(query_id, embedding) is a stated set, held against all rows, cell by cell; neither side passes the driver."""
    k = k or settings.top_k
    found = cells(vectors.where("embedding IS NOT NULL").select(F.col(key).alias("id"), "embedding"), queries.where("embedding IS NOT NULL").select("query_id", "embedding"), k)
    return ranked(found, k, ["query_id"]).withColumnRenamed("id", key)


def structured(hits: DataFrame, queries: DataFrame, k: int | None = None, settings: Settings = Settings(), key: str = "id") -> DataFrame:
    """Lines of lexical hits(query_id, key, rank, score, text) that look like records; a few of each hit, k of each question."""
    k = k or settings.top_k
    asked = queries.select("query_id", T.query_tokens(F.col("query")).alias("_t"))
    lines = T.structured_lines(F.col("text"), F.col("_t"), settings.lines_per_hit, settings.line_chars)
    each = hits.join(asked, "query_id").withColumn("_l", lines).select(*[c for c in hits.columns if c != "text"], F.posexplode("_l").alias("line", "text"))
    numbered = each.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "line"))).where(F.col("n") <= k)
    return numbered.withColumn(key, F.concat(F.col(key).cast("string"), F.lit("::line::"), F.col("line").cast("string"))).drop("n")


AGENTS = ("vector", "lexical", "structured")


def fan_out(agents: dict[str, DataFrame], key: str = "id") -> DataFrame:
    """All hits of all agents with their arrival order, first arrival of an id kept. Each has query_id, key, rank, score, and sub_query_idx and domain_idx where there are several."""
    parts = []
    for i, (name, hits) in enumerate(agents.items()):
        for c in ("sub_query_idx", "domain_idx"):
            hits = hits if c in hits.columns else hits.withColumn(c, F.lit(0))
        parts.append(hits.withColumns({"agent": F.lit(name), "agent_idx": F.lit(i)}).withColumn(key, F.col(key).cast("string")))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    order = Window.partitionBy("query_id", key).orderBy("sub_query_idx", "domain_idx", "agent_idx", "rank")
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def arrival(rows: DataFrame) -> DataFrame:
    """``arrival``: the place of a hit in its question's list."""
    return rows.withColumn("arrival", F.row_number().over(Window.partitionBy("query_id").orderBy("sub_query_idx", "domain_idx", "agent_idx", "rank")))


def diagnostics(attempts: DataFrame) -> DataFrame:
    """(query_id, agent, attempted, ok, zero_hits, timeout, error) of attempts(query_id, agent, status)."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    return attempts.groupBy("query_id", "agent").agg(F.count("*").alias("attempted"), *(count(s) for s in ("ok", "zero_hits", "timeout", "error")))
