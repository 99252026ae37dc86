"""Jobs as streams: the life cycle of each from its events, and a queue of ingestion requests."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lodestone.operators.chunk import chunks
from lodestone.settings import Settings
from lodestone.sources import store
from lodestone.sources.versions import Table

STATE = "kind string, status string, last_s double, created_s double, started_s double, finished_s double, error string"
JOBS = f"job_id string, {STATE}, stale boolean"
FINAL = ("succeeded", "failed")
PLACE = {"queued": 3, "running": 4, "succeeded": 5, "failed": 5}


class LifeCycle(StatefulProcessor):
    """A job's row from events(job_id, kind, event, at_s, error) in any order and any number of times.

    All that is kept of events is the latest or the greatest, so neither order nor repetition
    matters: the row is that of ``records.job_states`` over the events so far. A job without an end
    is closed as failed and stale when the watermark is ``stale_s`` past its last event; an event
    that comes later reopens it. A job with an end is forgotten ``keep_s`` after it.
    """

    def __init__(self, stale_s: float, keep_s: float) -> None:
        self.stale_s, self.keep_s = stale_s, keep_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.job = handle, handle.getValueState("job", STATE)

    def rows(self, key, held: tuple, stale: bool):
        import pandas as pd

        names = [c.split()[0] for c in JOBS.split(", ")]
        status, error = ("failed", held[6] or "stale") if stale else (held[1], held[6])
        return pd.DataFrame([(key[0], held[0], status, *held[2:6], error, stale)], columns=names)

    def clock(self, held: tuple) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        wait = self.keep_s if held[1] in FINAL else self.stale_s
        self.handle.registerTimer(int((held[2] + wait) * 1000))

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        old = self.job.get() if self.job.exists() else (None,) * 7
        kind, status, last, *times, error = old
        for part in rows:
            for k, event, at, err in zip(part["kind"], part["event"], part["at_s"], part["error"], strict=True):
                kind = k if kind is None else min(kind, k) if k is not None else kind
                if last is None or (at, event in FINAL, event) > (last, status in FINAL, status):
                    last, status = at, event
                i = PLACE[event] - 3
                times[i] = at if times[i] is None else max(times[i], at)
                error = err if error is None else max(error, err) if err is not None else error
        held = (kind, status, last, *times, error)
        self.job.update(held)
        self.clock(held)
        yield self.rows(key, held, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        if not self.job.exists():
            return
        held = tuple(self.job.get())
        if held[1] in FINAL:
            self.job.clear()
        else:
            yield self.rows(key, held, True)

    def close(self) -> None:
        pass


def life_cycle(events: DataFrame, stale_s: float = 3600.0, keep_s: float = 86400.0, late: str = "10 minutes") -> DataFrame:
    """JOBS, a row for each job that changed or went stale, of a stream of events(job_id, kind, event, ts, error). For output mode update; needs the RocksDB state store."""
    held = events.select(F.col("job_id").cast("string").alias("job_id"), "kind", "event", F.col("ts").cast("timestamp").alias("ts"), "error")
    held = held.withColumn("at_s", F.unix_micros("ts") / 1e6).withWatermark("ts", late)
    return held.groupBy("job_id").transformWithStateInPandas(LifeCycle(stale_s, keep_s), JOBS, "Update", "EventTime")


def enqueue(requests: DataFrame, folder: str) -> None:
    """Adds requests(job_id, source, text, …) to a queue's folder, as new files."""
    requests.write.mode("append").json(folder)


REQUEST = "job_id string, source string, source_type string, domain string, timestamp double, text string"


def work(folder: str, table: Table, checkpoint: str, settings: Settings = Settings()):
    """A query that does each request of a queue once: cuts its text into chunks and commits them with the request's line in the job log.

    Chunks and log are one commit, so a driver that dies has done both or neither, and the batch
    is done again; if its commit is there, it is left out. A request that any stream has in the
    log is not done again, nor one that is twice in the queue.
    """
    spark = table.spark

    def put(batch: DataFrame, number: int) -> None:
        stream = json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]
        asked = batch.where("job_id IS NOT NULL").dropDuplicates(["job_id"])
        if (done := log(table)) is not None:
            asked = asked.join(done.select("job_id"), "job_id", "left_anti")
        cut = store.namespaced(chunks(asked, settings).drop("job_id"))
        jobs = asked.select("job_id", F.col("source").alias("request_source"), F.lit(stream).alias("stream"), F.lit(number).cast("long").alias("batch"))
        table.put({"data": cut, "jobs": jobs}, txn=(stream, number))

    return spark.readStream.schema(REQUEST).json(folder).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def log(table: Table) -> DataFrame | None:
    """(job_id, request_source, stream, batch) of the requests done; None if there was none."""
    try:
        return table.read("jobs")
    except ValueError:
        return None
