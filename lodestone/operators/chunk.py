"""Word windows with overlap, their offsets and ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.settings import Settings


WINDOW = "array<struct<chunk:string,start:int,end:int>>"


def windows(words: Column, size: int, overlap: int) -> Column:
    """array<struct<first, chunk>>: the first word and the text of each window of a column of words."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the window")
    steps = F.sequence(F.lit(0), F.size(words) - 1, F.lit(size - overlap))
    made = F.transform(steps, lambda i: F.struct(F.get(words, i).alias("first"), F.array_join(F.slice(words, i + 1, F.lit(size)), " ").alias("chunk")))
    return F.when(F.size(words) > 0, made).otherwise(F.array().cast("array<struct<first:string,chunk:string>>"))


def placed(windows: Column, text: Column) -> Column:
    """array<struct<chunk, start, end>> of a column of windows.

    A window's start is searched from the end of the one before on; where its first word isn't
    found there, the start is that end.
    """

    def add(acc: Column, w: Column) -> Column:
        start = F.transform(F.array(F.position(w["first"], text, acc["at"] + 1)), lambda p: F.when(p > 0, p - 1).otherwise(acc["at"]))
        made = F.transform(start, lambda s: F.struct(w["chunk"].alias("chunk"), s.alias("start"), (s + F.length(w["chunk"])).alias("end")))
        return F.transform(made, lambda x: F.struct(x["end"].alias("at"), F.concat(acc["out"], F.array(x)).alias("out")))[0]

    return F.aggregate(windows, F.struct(F.lit(0).alias("at"), F.array().cast(WINDOW).alias("out")), add, lambda acc: acc["out"])


def chunks(docs: DataFrame, settings: Settings = Settings(), source: str = "source") -> DataFrame:
    """One row for each window of docs(text, …), with ``chunk_index``, ``id``, ``text`` and offsets. Other columns stay; no shuffle.

    Words and windows are columns of their own first: within the fold they would be made anew
    for each window. The outer explode keeps Spark from making them once more for a filter.
    """
    rest = [c for c in docs.columns if c != "text"]
    split = docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("_words", T.words(F.col("text")))
    cut = split.withColumn("_windows", windows(F.col("_words"), settings.chunk_words, settings.chunk_overlap))
    held = cut.withColumn("_chunks", placed(F.col("_windows"), F.col("text")))
    rows = held.select(*rest, F.posexplode_outer("_chunks").alias("chunk_index", "_c")).where("chunk_index IS NOT NULL")
    name = F.concat(F.element_at(F.split(F.col(source), "/"), -1), F.lit(":"), F.col("chunk_index").cast("string"))
    return rows.select(*rest, "chunk_index", T.name_uuid(name).alias("id"), F.col("_c.chunk").alias("text"), F.col("_c.start").alias("offset_start"), F.col("_c.end").alias("offset_end"))
