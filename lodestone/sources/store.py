"""Tables of the engine on disk: chunks by namespace, replacement by source, logs, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T

NAMESPACE = ("collection",)


def namespaced(chunks: DataFrame) -> DataFrame:
    """chunks with the names of their collection and index; the domain goes before the tenant."""
    t = F.col("tenant") if "tenant" in chunks.columns else F.lit(None).cast("string")
    d = F.col("domain") if "domain" in chunks.columns else F.lit(None).cast("string")
    return chunks.withColumns({"collection": T.namespace("docs", t, d), "index": T.namespace("docs_index", t, d)})


def replace_sources(stored: DataFrame, new: DataFrame, by: tuple[str, ...] = ("collection", "source")) -> DataFrame:
    """stored without the sources that new has rows of, and new. A source without new rows keeps its old ones."""
    return stored.join(new.select(*by).distinct(), list(by), "left_anti").unionByName(new, allowMissingColumns=True)


def delete_source(rows: DataFrame, source: str, tenant: str | None = None) -> DataFrame:
    """Rows of all namespaces without a source; with a tenant only its rows go."""
    gone = F.col("source") == source
    if tenant is not None:
        gone = gone & (F.col("tenant") == tenant)
    return rows.where(~F.coalesce(gone, F.lit(False)))


def write_chunks(rows: DataFrame, path: str, batch: int | None = None) -> None:
    """One folder for each collection; only the collections that rows has are written anew."""
    w = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (w.option("maxRecordsPerFile", batch) if batch else w).partitionBy(*NAMESPACE).parquet(path)


def read_collection(spark, path: str, domain: str | None, tenant: str | None) -> DataFrame:
    """The domain's collection, else the tenant's, else the base one, whichever exists. Folders are listed, and the filter prunes them."""
    rows = spark.read.parquet(path)
    wanted = [f"docs_{x}" for x in (domain or tenant,) if x]
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    there = lambda n: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(at, f"collection={n}"))
    return rows.where(F.col("collection") == next((n for n in wanted if there(n)), "docs"))


def domains(indices: DataFrame) -> DataFrame:
    """(domain) of index names behind the base name."""
    return indices.select(F.regexp_extract("index", "^docs_index_(.+)$", 1).alias("domain")).where("domain <> ''").distinct()


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def export_jsonl(rows: DataFrame, path: str, limit: int) -> int:
    """The newest rows as JSON lines in one file; returns their number, which the limit bounds."""
    top = rows.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)
    top.coalesce(1).write.mode("overwrite").json(path)
    return rows.sparkSession.read.text(path).count()


def events_text(rows: DataFrame) -> DataFrame:
    """rows(event, data) as server-sent events."""
    return rows.withColumn("frame", F.concat(F.lit("event: "), "event", F.lit("\ndata: "), F.to_json(F.struct("data")), F.lit("\n\n")))
