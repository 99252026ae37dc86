"""Structured Streaming forms of the engine's running records and of ingestion."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.chunk import chunks
from lodestone.plans.engine import Engine
from lodestone.settings import Settings
from lodestone.sources import store
from lodestone.sources.answers import AnswerCache
from lodestone.sources.versions import Table


def request_windows(events: DataFrame, client: str = "user_id", span: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """(client, window_start, n): requests in fixed windows of event time. The watermark bounds the state."""
    held = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return held.groupBy(client, F.window("ts", span).alias("w")).agg(F.count("*").alias("n")).select(client, F.col("w.start").alias("window_start"), "n")


def sliding_rates(events: DataFrame, labels: list[str], span: str = "5 minutes", step: str = "15 seconds", late: str = "10 minutes") -> DataFrame:
    """(labels, window_start, n) over sliding windows, as dashboards ask for."""
    held = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return held.groupBy(*labels, F.window("ts", span, step).alias("w")).agg(F.count("*").alias("n")).select(*labels, F.col("w.start").alias("window_start"), "n")


def running_counters(events: DataFrame, labels: list[str]) -> DataFrame:
    """Counts since the start; for output modes update and complete."""
    return events.groupBy(*labels).agg(F.count("*").alias("n"))


def ingest(files: DataFrame, table: Table, checkpoint: str, settings: Settings = Settings(), then: Callable[[DataFrame], None] | None = None):
    """A query that cuts arriving files(text, source, …) into chunks and commits them to a table, in place of their sources' earlier ones.

    A batch is committed under the stream's own id, which its checkpoint holds: one that is run
    again after a failure is left out if its commit is there, and a stream with another checkpoint
    is another stream, whose commits come after those that are there.
    """
    spark = files.sparkSession

    def put(batch: DataFrame, number: int) -> None:
        stream = json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]
        if table.put(store.namespaced(chunks(batch, settings)), txn=(stream, number)) is not None and then:
            then(batch)

    return files.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def serve(requests: DataFrame, engine: Engine, corpus: DataFrame, cache: AnswerCache, out: Table, checkpoint: str, clock: Callable[[], float] = time.time):
    """A query that answers arriving requests(query_id, query, …), from the cache where it can, and commits each batch's answers once.

    A driver that dies after answers are remembered and before they are committed finds them in
    the cache: they are committed then, as hits if they haven't expired.
    """
    spark = requests.sparkSession

    def put(batch: DataFrame, number: int) -> None:
        stream = json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]
        asked = batch.where("query_id IS NOT NULL").dropDuplicates(["query_id"])
        if any(e["txns"].get(stream, -1) >= number for e in out.log()) or asked.isEmpty():
            return
        out.put(engine.answer_cached(corpus, asked, cache, clock()), txn=(stream, number))

    return requests.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def answer_events(answers: DataFrame) -> DataFrame:
    """(query_id, seq, event, data): meta, the answer's words, final, done."""
    words = F.split("answer", "(?<= )")
    each = F.concat(
        F.array(F.struct(F.lit("meta").alias("event"), F.to_json(F.struct("query_id")).alias("data"))),
        F.transform(words, lambda w: F.struct(F.lit("token").alias("event"), w.alias("data"))),
        F.array(F.struct(F.lit("final").alias("event"), F.to_json(F.struct("answer", "provenance", "confidence")).alias("data")), F.struct(F.lit("done").alias("event"), F.lit("").alias("data"))),
    )
    return answers.select("query_id", F.posexplode(each).alias("seq", "_e")).select("query_id", "seq", "_e.event", "_e.data")
