"""A stored table of answers with a time to live."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.versions import Table

HOUR = 3600
KIND = "key string, value string, expires_at double"


class AnswerCache:
    """Values by key until they expire. They lie in folders by the hour in which they expire, so what is long expired isn't read; ``evict`` removes it."""

    def __init__(self, spark: SparkSession, path: str, ttl_s: float = 300.0) -> None:
        self.spark, self.ttl_s = spark, ttl_s
        self.table = Table(spark, path, ("key",), {"data": ("hour",)})

    def put(self, rows: DataFrame, now: float, txn: tuple[str, int] | None = None) -> int | None:
        """rows(key, value), one for each key, in place of older ones."""
        expires = now + self.ttl_s
        return self.table.put(rows.select("key", "value", F.lit(expires).alias("expires_at"), F.lit(int(expires // HOUR)).cast("long").alias("hour")), txn=txn)

    def live(self, now: float) -> DataFrame:
        """KIND: what hasn't expired."""
        if not self.table.versions():
            return self.spark.createDataFrame([], KIND)
        return self.table.read().where((F.col("hour") >= int(now // HOUR)) & (F.col("expires_at") > now)).drop("hour")

    def get(self, keys: DataFrame, now: float) -> DataFrame:
        """(key, value) of keys(key, …) that are there."""
        return self.live(now).select("key", "value").join(keys.select("key").distinct(), "key", "left_semi")

    def evict(self, now: float, age_s: float = 86400.0) -> None:
        """Writes what is live as one commit and removes the folders before it; readers of older versions must be done."""
        self.table.compact(F.col("expires_at") > now)
        self.table.vacuum(age_s)
