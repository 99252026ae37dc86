"""From hits to ranked evidence: normal form, duplicates, author preference, order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.settings import Settings


def by_query(*order):
    return Window.partitionBy("query_id").orderBy(*order) if order else Window.partitionBy("query_id")


def normalize(hits: DataFrame) -> DataFrame:
    """Flat evidence of hits with ``payload`` and ``source`` structs; an empty payload value gives way to the source's. An offset of 0 in the payload counts as empty. Rows without text go."""
    pick = lambda f, empty="": F.coalesce(T.falsy(F.col(f"payload.{f}"), empty), F.col(f"source.{f}"))
    rows = hits.select(
        "query_id", "id", pick("text").alias("text"), pick("source").alias("source"), pick("timestamp", 0.0).alias("timestamp"),
        pick("offset_start", 0).alias("offset_start"), pick("offset_end", 0).alias("offset_end"),
        F.lower(pick("source_type")).alias("source_type"), F.lower(pick("domain")).alias("domain"), "score", "agent", "arrival",
    )
    return rows.where(T.falsy(F.col("text"), "").isNotNull())


def first_by(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def dedupe_text(rows: DataFrame, keys: tuple[str, ...] = (), order: tuple[str, ...] = ("arrival",), text: str = "text") -> DataFrame:
    """The first of the rows whose squeezed text is equal. They meet by a hash of 128 bits of the text, so the texts aren't compared in a sort."""
    held = rows.withColumn("_f", F.md5(T.squeezed(F.coalesce(F.col(text), F.lit(""))).cast("binary")))
    return first_by(held, [*keys, "_f"], list(order)).drop("_f")


def matches_author(terms: Column, source: Column, text: Column, index: dict[str, list[str]] | None = None) -> Column:
    """Whether an author's name is in the source or text, or the author index has the source."""
    low, said = F.lower(F.coalesce(source, F.lit(""))), F.lower(F.coalesce(text, F.lit("")))
    out = F.exists(terms, lambda t: F.contains(low, t) | F.contains(said, t))
    if index:
        known = F.create_map(*(x for k, v in index.items() for x in (F.lit(k.lower()), T.literals([s.lower() for s in v]))))
        out = out | F.exists(terms, lambda t: F.coalesce(F.array_contains(F.try_element_at(known, t), low), F.lit(False)))
    return out


def author_bias(terms: Column, source: Column, text: Column, settings: Settings = Settings()) -> Column:
    """Bias of a row: name in the source, in the text, or none; null without terms."""
    low, said = F.lower(F.coalesce(source, F.lit(""))), F.lower(F.coalesce(text, F.lit("")))
    bias = F.when(F.exists(terms, lambda t: F.contains(low, t)), settings.author_bias_source).when(F.exists(terms, lambda t: F.contains(said, t)), settings.author_bias_text).otherwise(0.0)
    return F.when(F.size(terms) > 0, bias)


def rerank(rows: DataFrame, settings: Settings = Settings(), score: str | None = "rerank_score") -> DataFrame:
    """Top rows of each question by a reranker's score, arrival as tie-break; without one the first to arrive."""
    order = [F.desc(score), "arrival"] if score else ["arrival"]
    return rows.withColumn("place", F.row_number().over(by_query(*order))).where(F.col("place") <= settings.rerank_top_k)


def bias_sort(rows: DataFrame) -> DataFrame:
    """New places by score plus bias; equal ones keep their order."""
    total = F.coalesce("rerank_score", "score", F.lit(0.0)) + F.coalesce("author_bias", F.lit(0.0))
    return rows.withColumn("sort_score", total).withColumn("place", F.row_number().over(by_query(F.desc("sort_score"), "place")))


def prefer_author(rows: DataFrame) -> DataFrame:
    """Keeps a question's author rows if there are any, plus ``author_gap``.

    rows has is_author and has_term (whether a query term is in the text) and has_terms
    (whether the question has query terms). With terms, author rows with one stay; if there is
    none, it is a gap: all rows stay, and those of others are sorted without the bias.
    """
    some = lambda c: F.max(c.cast("int")).over(by_query()) == 1
    author, term = F.col("is_author"), F.col("has_term")
    held = rows.withColumns({"_any": some(author), "_both": some(author & term)})
    gap = F.col("_any") & F.col("has_terms") & ~F.col("_both")
    keep = ~F.col("_any") | F.when(F.col("has_terms"), (author & term) | gap).otherwise(author)
    held = held.withColumn("author_gap", gap).where(keep)
    plain = F.col("sort_score") - F.when(F.col("author_gap"), F.coalesce("author_bias", F.lit(0.0))).otherwise(0.0)
    return held.withColumn("sort_score", plain).withColumn("place", F.row_number().over(by_query(F.desc("sort_score"), "place"))).drop("_any", "_both")


def gap_filter(rows: DataFrame) -> DataFrame:
    """Under a gap, rows of others only, if there are any."""
    other = F.max((~F.col("is_author")).cast("int")).over(by_query()) == 1
    return rows.withColumn("_other", other).where(~(F.col("author_gap") & F.col("_other") & F.col("is_author"))).drop("_other")


def pick(rows: DataFrame, trusted: DataFrame, author_gap: bool = False) -> DataFrame:
    """Trusted evidence in the order of trust, else the first three; trusted(query_id, trusted_ids). With author_gap, rows of others if the picks have any."""
    ids = trusted.select("query_id", F.posexplode("trusted_ids").alias("trust", "id"))
    chosen = rows.join(ids, ["query_id", "id"]).withColumn("pick", F.row_number().over(by_query("trust", "place"))).drop("trust")
    rest = rows.join(chosen.select("query_id").distinct(), "query_id", "left_anti").where("place <= 3").withColumn("pick", F.col("place"))
    out = chosen.unionByName(rest)
    return gap_filter(out.withColumn("author_gap", F.lit(True))).drop("author_gap") if author_gap else out


def provenance(rows: DataFrame) -> DataFrame:
    """(query_id, provenance) of rows that have both offsets and a source, in order."""
    full = F.col("offset_start").isNotNull() & F.col("offset_end").isNotNull() & T.falsy(F.col("source"), "").isNotNull()
    one = F.struct("pick", "id", "source", "offset_start", "offset_end")
    sorted_ = F.array_sort(F.collect_list(F.when(full, one)))
    return rows.groupBy("query_id").agg(F.transform(sorted_, lambda x: F.struct(x["id"].alias("id"), x["source"].alias("source"), x["offset_start"].alias("offset_start"), x["offset_end"].alias("offset_end"))).alias("provenance"))


def repair_provenance(items: DataFrame, rows: DataFrame) -> DataFrame:
    """A model's items(query_id, item, id or chunk_id, source, offset_start, offset_end), completed from the evidence; incomplete ones go."""
    held = items.withColumn("id", F.coalesce("id", "chunk_id")).drop("chunk_id").alias("i").join(rows.alias("r"), ["query_id", "id"], "left")
    full = held.select("query_id", "item", "id", *(F.coalesce(f"i.{c}", f"r.{c}").alias(c) for c in ("source", "offset_start", "offset_end")))
    return full.where("offset_start IS NOT NULL AND offset_end IS NOT NULL AND source <> ''")


def agent_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("query_id", F.coalesce(T.falsy(F.col("agent"), ""), F.lit("unknown")).alias("agent")).agg(F.count("*").alias("n"))


def distinct_domains(rows: DataFrame) -> DataFrame:
    return rows.groupBy("query_id").agg(F.array_sort(F.collect_set(T.falsy(F.col("domain"), ""))).alias("domains"))
