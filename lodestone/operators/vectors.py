"""A stored vector index: lists of vectors by their nearest centroid, searched list by list.

Centroids are fitted by k-means on SAMPLE vectors at most, a documented bound; every vector then
goes to the list of its nearest one, a folder of its own. A search takes each question's PROBES
nearest lists, reads those folders only and scores their vectors exactly, as products of matrices
in Arrow batches. With ``exact`` it then reads every list that may hold a better one: a list's
vectors lie within its radius of the centroid, which bounds their cosine with a question.

The index is a ``Table``: a source that comes again, or is deleted, touches no other source's
rows. Null vectors and those without a length are left out, as are such questions.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import retrieve
from lodestone.operators.retrieve import cells, ranked
from lodestone.settings import Settings
from lodestone.sources.scratch import keep
from lodestone.sources.versions import Table

SAMPLE = 50_000
PROBES = 4
#: Vectors of a list that the number of lists aims at, and the most lists.
PER_LIST, MOST_LISTS = 500, 1024
#: Questions that are held against the lists at once (of older callers; cells bound it now).
TOGETHER = 5_000
SLACK = 1e-9
#: Questions whose cosines with all centroids are held at once.
ROWS = 1024


def unit_rows(values):
    """(row numbers, unit vectors) of a list column: those that have a length."""
    import numpy as np

    rows = [(i, np.asarray(v, "f8")) for i, v in enumerate(values) if v is not None and all(x is not None for x in v)]
    rows = [(i, v / n) for i, v in rows if (n := float(np.sqrt(v @ v))) > 0]
    return [i for i, _ in rows], np.array([v for _, v in rows])


class VectorIndex:
    def __init__(self, spark: SparkSession, path: str, settings: Settings = Settings()) -> None:
        self.spark, self.settings = spark, settings
        self.table = Table(spark, path, ("source",), {"vectors": ("list",)})

    def fit(self, rows: DataFrame, seed: int = 7) -> list[list[float]]:
        """Centroids of rows(embedding), of a sample of SAMPLE rows in expectation."""
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        rows = rows.where(F.exists("embedding", lambda x: x != 0) & F.forall("embedding", lambda x: x.isNotNull()))
        n = rows.count()
        lists = max(1, min(MOST_LISTS, -(-n // PER_LIST)))
        held = rows.sample(min(1.0, SAMPLE / max(1, n)), seed=seed).select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
        if lists == 1 or held.limit(1).count() == 0:
            return []
        model = KMeans(k=lists, seed=seed, maxIter=10, distanceMeasure="cosine").fit(held)
        return [list(map(float, c)) for c in model.clusterCenters()]

    def add(self, rows: DataFrame, centroids: list[list[float]] | None = None) -> int | None:
        """Indexes rows(id, source, embedding). Centroids are those of the first commit, fitted on its rows unless given."""
        rows = rows.select("id", F.coalesce("source", F.lit("")).alias("source"), "embedding").where("embedding IS NOT NULL")
        known = self.centroids() if self.table.log() else None
        centroids = known if known is not None else self.fit(rows) if centroids is None else centroids
        # A list's vectors go to one task or to neighbours: by hash of the row, every task would write a file in every list's folder.
        placed = nearest(rows, centroids).repartitionByRange("list", F.xxhash64("id"))
        sums = (F.min("near").alias("least"), F.count("*").alias("n"))
        keys = lambda held: held["vectors"].groupBy("source", "list").agg(*sums)
        first = {"centroids": self.spark.createDataFrame([(json.dumps(centroids),)], "centroids string")} if known is None else {}
        return self.table.put({"vectors": placed, "keys": keys} | first)

    def delete(self, source: str) -> int:
        return self.table.delete(source)

    def lists(self) -> DataFrame:
        """(source, list, least, n): the least cosine of each list's vectors with its centroid."""
        return self.table.read("keys")

    def centroids(self) -> list[list[float]] | None:
        """Those of the first commit, written once: in a row for each list they would grow with the square of the lists."""
        row = self.table.read("centroids").first()
        return json.loads(row[0]) if row else None

    def search(self, queries: DataFrame, k: int | None = None, probes: int = PROBES, exact: bool = False) -> DataFrame:
        """The k best vectors of each of queries(query_id, embedding) by cosine, within its nearest lists or, exact, among all."""
        k = k or self.settings.top_k
        radii = {r["list"]: r["least"] for r in self.lists().groupBy("list").agg(F.min("least").alias("least")).collect()}  # MOST_LISTS at most
        centroids = (self.centroids() or []) if radii else []
        queries = keep(queries.select("query_id", "embedding"), "asked-vectors")
        found = keep(self.scores(near_lists(queries, centroids, radii, probes), k), "vector-hits")
        if exact and centroids:
            last = ranked(found, k, ["query_id"]).where(F.col("rank") == k).select("query_id", F.col("score").alias("_last"))
            more = near_lists(queries.join(last, "query_id", "left"), centroids, radii, probes)
            found = found.union(self.scores(more, k))
        return ranked(found, k, ["query_id"])

    def scores(self, asked: DataFrame, k: int) -> DataFrame:
        """(query_id, id, score): each cell's k best of asked(query_id, embedding, lists) within the lists."""
        asked = keep(asked.where(F.exists("lists", lambda x: x != 0)), "asked-lists")
        words = asked.select(F.posexplode("lists").alias("at", "word")).groupBy("at").agg(F.bit_or("word").alias("word")).collect()
        folders = [64 * r["at"] + i for r in words for i in range(64) if r["word"] >> i & 1]  # MOST_LISTS at most
        return cells(self.table.read("vectors").where(F.col("list").isin(folders)).select("id", "list", "embedding"), asked, k)


def nearest(rows: DataFrame, centroids: list[list[float]]) -> DataFrame:
    """rows(id, source, embedding) with the nearest centroid's number as ``list`` and the cosine with it as ``near``. Vectors without a length are left out."""
    id_kind, kind = (rows.schema[c].dataType.simpleString() for c in ("id", "embedding"))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        c = unit_rows(centroids)[1] if centroids else None
        for b in batches:
            kept, v = retrieve.unit_rows(b.column(2))
            near = v @ c.T if c is not None and len(kept) else np.ones((len(kept), 1))
            place = near.argmax(1) if len(kept) else np.zeros(0, "i4")
            part = b.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(place, pa.int32()), pa.array(near[np.arange(len(kept)), place], pa.float64())], names=["id", "source", "embedding", "list", "near"])

    return rows.mapInArrow(run, f"id {id_kind}, source string, embedding {kind}, list int, near double")


def near_lists(queries: DataFrame, centroids: list[list[float]], radii: dict[int, float], probes: int) -> DataFrame:
    """(query_id, embedding, lists) of queries(query_id, embedding[, _last]): the nearest probes of the lists that hold vectors; with _last, all others that may hold a vector of that cosine (any, where it is null). Lists are bits of an array of longs, so that a question takes no more room with many."""
    more = "_last" in queries.columns
    rows = queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding"), *(["_last"] if more else [])).where("embedding IS NOT NULL")
    kind = rows.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        held = np.array(sorted(radii), "i4")
        words = int(held.max(initial=0)) // 64 + 1
        c = unit_rows([centroids[i] for i in held])[1] if centroids else None
        wide = np.arccos(np.clip([radii[i] for i in held], -1, 1)) if centroids else np.zeros(len(held))
        for b in batches:
            kept, v = retrieve.unit_rows(b.column(1))
            last = b.column(2).to_numpy(zero_copy_only=False).astype("f8")[kept] if more else None
            bits = np.zeros((len(kept), words), "<i8")
            for low in range(0, len(kept), ROWS):
                near = np.clip(v[low : low + ROWS] @ c.T, -1, 1) if c is not None else np.ones((len(v[low : low + ROWS]), len(held)))
                first = np.zeros(near.shape, bool)
                np.put_along_axis(first, np.argsort(-near, axis=1, kind="stable")[:, :probes], True, 1)
                if more:
                    bound = np.cos(np.maximum(0.0, np.arccos(near) - wide)) + 1e-12
                    first = ~first & ~(bound < last[low : low + ROWS, None] - SLACK)  # a null is no number: all may
                every = np.zeros((len(near), 64 * words), bool)
                every[:, held] = first
                bits[low : low + ROWS] = np.packbits(every, axis=1, bitorder="little").view("<i8")
            part = b.take(pa.array(kept, pa.int64()))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(kept) + 1) * words, pa.int32()), pa.array(bits.ravel(), pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], names=["query_id", "embedding", "lists"])

    return rows.mapInArrow(run, f"query_id {kind}, embedding array<double>, lists array<long>")
