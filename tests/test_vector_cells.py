"""Vector searches in several cells and tasks; what the vector index writes."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodestone.llm.common import setting
from lodestone.operators import retrieve, vectors
from lodestone.operators.vectors import VectorIndex
from tests.test_vectors import SCHEMA, got, plain

r = random.Random(5)
ROWS = [(i, "s", [r.gauss(0, 1) for _ in range(4)]) for i in range(120)]
ASKED = [(i, v) for i, _, v in ROWS if i % 6 == 0]


@pytest.mark.parametrize(("of_vectors", "of_queries"), [(40, 5), (40, 8192), (32_768, 5), (1, 8192)])
def test_both_sides_of_a_cell_meet_in_one_task(spark, monkeypatch, of_vectors, of_queries):
    """Spark must not put small shuffles together, as it doesn't with large ones. The last case has cells without a vector."""
    monkeypatch.setattr(retrieve, "CELL_VECTORS", of_vectors)
    monkeypatch.setattr(retrieve, "CELL_QUERIES", of_queries)
    v = spark.createDataFrame(ROWS, SCHEMA)
    q = spark.createDataFrame(ASKED, "query_id long, embedding array<double>")
    with setting(spark, "spark.sql.adaptive.enabled", "false"):
        assert got(retrieve.vector(v, q, 5)) == sorted(plain(ROWS, ASKED, 5))


def test_rows_without_a_length(spark):
    v = spark.createDataFrame([(1, "s", [None, 1.0]), (2, "s", []), (3, "s", None), (4, "s", [0.0, 0.0])], SCHEMA)
    assert retrieve.vector(v, v.select(F.col("id").alias("query_id"), "embedding"), 5).collect() == []


def test_what_the_index_writes(spark, tmp_path, monkeypatch):
    """Centroids once, not in a row for each list; a list's vectors in one file or few, not one of each task."""
    monkeypatch.setattr(vectors, "PER_LIST", 2)
    x = VectorIndex(spark, str(tmp_path / "x"))
    x.add(spark.createDataFrame(ROWS, SCHEMA).repartition(8))
    lists = x.lists().select("list").distinct().count()
    assert lists > 30 and "centroids" not in x.lists().columns
    assert len(list(Path(tmp_path / "x" / "vectors").rglob("*.parquet"))) <= lists + 8
    q = spark.createDataFrame(ASKED, "query_id long, embedding array<double>")
    assert got(x.search(q, 5, exact=True)) == sorted(plain(ROWS, ASKED, 5))
    x.add(spark.createDataFrame([(500, "t", ROWS[0][2])], SCHEMA))  # placed by the same centroids
    assert got(x.search(q, 5, exact=True)) == sorted(plain([*ROWS, (500, "t", ROWS[0][2])], ASKED, 5))
    x.delete("s"), x.delete("t")
    assert x.search(q, 5, exact=True).collect() == []
