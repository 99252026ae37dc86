"""A table as a log of commits over Parquet folders: replacement by source, deletion, streams, compaction.

A commit writes its rows into folders of its own, which nobody reads until its entry is in the
log; entries are numbered and put there by a rename that never replaces one. So writers need not
know of each other, a job that dies leaves only folders that no entry names, and readers see
whole commits. What counts of a row follows from the log alone: rows of a source are replaced by
a later commit that has rows of it (by key where the commit says so), and gone after a later
deletion of the source. A stream's batch is committed once: entries carry the stream's own id and
its batch number, and a batch that isn't newer than the stream's last one is left out.

Compaction writes what counts up to a version and stands for all entries up to it; commits that
came meanwhile keep their place behind. ``vacuum`` removes folders that no reader needs.

The rename is exclusive on HDFS and stores with the same promise; on a local disk, writers of one
driver are kept apart by a lock.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Rows, or a function that makes them of the commit's datasets that are stored already.
Frame = DataFrame | Callable[[dict[str, DataFrame]], DataFrame]
_locks: dict[str, threading.Lock] = defaultdict(threading.Lock)


class Table:
    """Datasets under one path with one log. ``by`` names the columns whose values are replaced together; every dataset has them."""

    def __init__(self, spark: SparkSession, path: str, by: tuple[str, ...] = ("collection", "source"), parts: dict[str, tuple[str, ...]] | None = None) -> None:
        self.spark, self.path, self.by = spark, path.rstrip("/"), by
        #: Folders of each dataset within a commit.
        self.parts = {"data": ("collection",)} if parts is None else parts

    # the log

    def _at(self, *names: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *names]))

    def _fs(self):
        return self._at().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def log(self, upto: int | None = None) -> list[dict]:
        """Entries by version. Their number is that of the commits since the log was last trimmed."""
        fs, folder = self._fs(), self._at("log")
        if not fs.exists(folder):
            return []
        out = []
        for status in fs.listStatus(folder):
            name = status.getPath().getName()
            if name.endswith(".json") and not name.startswith(("_", ".")) and (upto is None or int(name[:-5]) <= upto):
                stream = fs.open(status.getPath())
                try:
                    out.append(json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
                finally:
                    stream.close()
        return sorted(out, key=lambda e: e["version"])

    def _publish(self, entry: dict, txn: tuple[str, int] | None = None) -> int | None:
        jvm, fs = self.spark._jvm, self._fs()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at().toUri(), self.spark._jsc.hadoopConfiguration())
        plain = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        with _locks[self.path]:
            while True:
                log = self.log()
                if txn and any(e["txns"].get(txn[0], -1) >= txn[1] for e in log):
                    return None
                version = log[-1]["version"] + 1 if log else 1
                told = {"rank": version, "txns": {txn[0]: txn[1]} if txn else {}} | entry | {"version": version}
                temporary, final = self._at("log", f"_{uuid.uuid4().hex}"), self._at("log", f"{version:020d}.json")
                stream = fs.create(temporary, False)
                stream.write(bytearray(json.dumps(told, sort_keys=True).encode()))
                stream.close()
                if not fs.exists(final):
                    try:
                        context.rename(temporary, final, plain)
                        return version
                    except Exception as error:
                        if "FileAlreadyExists" not in str(error):
                            raise
                fs.delete(temporary, False)

    def _active(self, upto: int | None = None) -> tuple[list[dict], list[dict]]:
        """(commits that may have rows, deletions), as of a version."""
        log = self.log(upto)
        base = max((e for e in log if e["kind"] == "compact"), key=lambda e: (e["rank"], e["version"]), default=None)
        rank = base["rank"] if base else 0
        later = [e for e in log if e["kind"] != "compact" and e["version"] > rank]
        return [*([base] if base else []), *(e for e in later if e["kind"] == "put")], [e for e in later if e["kind"] == "delete"]

    # writing

    def _write(self, frames: dict[str, Frame], unit: tuple[str, ...] | None) -> dict:
        commit, schemas, stored = uuid.uuid4().hex, {}, {}
        for name, rows in frames.items():
            rows = rows if isinstance(rows, DataFrame) else rows(stored)
            folders = [c for c in self.parts.get(name, ()) if c in rows.columns]
            w = rows.write
            (w.partitionBy(*folders) if folders else w).parquet(f"{self.path}/{name}/commit={commit}")
            schemas[name] = json.loads(rows.schema.json())
            stored[name] = self.spark.read.schema(rows.schema).parquet(f"{self.path}/{name}/commit={commit}")
        if unit and "keys" not in frames:
            keys = next(iter(stored.values())).select(*unit).distinct()
            keys.write.parquet(f"{self.path}/keys/commit={commit}")
            schemas["keys"] = json.loads(keys.schema.json())
        return {"commit": commit, "schemas": schemas, "unit": list(unit or ())}

    def put(self, rows: DataFrame | dict[str, Frame], unit: tuple[str, ...] | None = None, txn: tuple[str, int] | None = None, append: bool = False) -> int | None:
        """Commits rows in place of older ones of the same unit (the table's own, or for example ``("collection", "id")``), or beside them; returns the version.

        Of several datasets, one may be a function of those before it as they are stored. A dataset
        ``keys`` of the unit's columns may come with them, with columns of its own.
        txn is (id of a stream, number of a batch): None is returned for one that is there already.
        """
        if txn and any(e["txns"].get(txn[0], -1) >= txn[1] for e in self.log()):
            return None
        frames = rows if isinstance(rows, dict) else {"data": rows}
        held = {(n, f["name"]): f["type"] for e in self._active()[0] for n, schema in e["schemas"].items() for f in schema["fields"]}
        for name, frame in frames.items():
            if not isinstance(frame, DataFrame):
                continue
            for f in json.loads(frame.schema.json())["fields"]:
                if not isinstance(f["type"], dict) and held.get((name, f["name"]), f["type"]) != f["type"]:
                    raise ValueError(f"{name}.{f['name']} is {held[name, f['name']]} in the table, {f['type']} in the rows")
        return self._publish({"kind": "put"} | self._write(frames, None if append else unit or self.by), txn)

    def delete(self, source: str, tenant: str | None = None) -> int:
        """A source goes from all collections; with a tenant only its rows. Nothing is rewritten."""
        return self._publish({"kind": "delete", "source": source, "tenant": tenant})

    def compact(self, where: Column | None = None) -> int | None:
        """Writes what counts now as one commit that stands for all before it; with a condition, only its rows."""
        log = self.log()
        if not log:
            return None
        upto = log[-1]["version"]
        puts, _ = self._active(upto)
        names = list(dict.fromkeys(n for e in puts for n in e["schemas"] if n != "keys"))
        frames = {n: self.read(n, upto) if where is None else self.read(n, upto).where(where) for n in names}
        if any("keys" in e["schemas"] and set(x["name"] for x in e["schemas"]["keys"]["fields"]) > set(self.by) for e in puts):
            frames["keys"] = self.read("keys", upto)
        txns: dict[str, int] = {}
        for e in log:
            txns |= {k: max(v, txns.get(k, -1)) for k, v in e["txns"].items()}
        return self._publish({"kind": "compact", "rank": upto, "txns": txns} | self._write(frames, self.by))

    def vacuum(self, age_s: float = 86400.0) -> int:
        """Removes folders of commits that compaction replaced, entries before it, and folders without an entry that are older than age_s. Readers of older versions must be done."""
        fs, log = self._fs(), self.log()
        puts, _ = self._active()
        needed, named = {e["commit"] for e in puts}, {e["commit"] for e in log if "commit" in e}
        base, gone = max((e["rank"] for e in log if e["kind"] == "compact"), default=0), 0
        for status in fs.listStatus(self._at()):
            if status.getPath().getName() == "log":
                continue
            for folder in fs.listStatus(status.getPath()):
                commit = folder.getPath().getName().removeprefix("commit=")
                if commit not in needed and (commit in named or folder.getModificationTime() / 1000 < time.time() - age_s):
                    gone += fs.delete(folder.getPath(), True)
        for e in log:
            if e["version"] <= base and e["version"] != log[-1]["version"] and e.get("commit") not in needed:
                fs.delete(self._at("log", f"{e['version']:020d}.json"), False)
        return gone

    # reading

    def _dataset(self, name: str, puts: list[dict]) -> DataFrame | None:
        """Rows of a dataset with their commit's rank. Columns that older commits lack read as null."""
        held = [e for e in puts if name in e["schemas"]]
        if not held:
            return None
        fields: dict[str, StructField] = {}
        for e in held:
            fields |= {f.name: f for f in StructType.fromJson(e["schemas"][name]).fields}
        schema = StructType([*fields.values(), StructField("commit", StringType())])
        rows = self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(*(f"{self.path}/{name}/commit={e['commit']}" for e in held))
        ranks = self.spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(e["commit"]).alias("commit"), F.lit(e["rank"]).cast("long").alias("_rank")) for e in held))))
        return rows.join(F.broadcast(ranks), "commit").drop("commit")

    def read(self, name: str = "data", version: int | None = None) -> DataFrame:
        """What counts of a dataset, now or as of a version."""
        puts, gone = self._active(version)
        rows = self._dataset(name, puts)
        if rows is None:
            raise ValueError(f"no commit has {name}")
        units = {tuple(e["unit"]) for e in puts if e["unit"]}
        if len(puts) > 1:
            for unit in units:
                if not set(unit) <= set(rows.columns):
                    continue
                keys = self._dataset("keys", [e for e in puts if tuple(e["unit"]) == unit])
                latest = keys.groupBy(*(F.col(c).alias(f"_{c}") for c in unit)).agg(F.max("_rank").alias("_latest"))
                on = [rows[c].eqNullSafe(latest[f"_{c}"]) for c in unit]
                rows = rows.join(latest, [*on, rows["_rank"] < latest["_latest"]], "left_anti")
        if gone and "source" in rows.columns:
            dead = self.spark.createDataFrame([(e["source"], e["tenant"], e["version"]) for e in gone], "_s string, _t string, _v long")
            hit = (F.col("source") == F.col("_s")) & (F.col("_rank") < F.col("_v"))
            hit = hit & (F.col("_t").isNull() | (F.col("tenant") == F.col("_t"))) if "tenant" in rows.columns else hit & F.col("_t").isNull()
            rows = rows.join(F.broadcast(dead), hit, "left_anti")
        return rows.drop("_rank")

    def versions(self) -> list[int]:
        return [e["version"] for e in self.log()]
