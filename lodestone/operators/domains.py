"""Search by domain: each question in the indexes of its domains, each index with statistics of its own.

Postings lie in a folder for each index. Questions say which indexes they want; a join on the index
and the term reads those folders only, which Spark finds out when it runs (dynamic partition
pruning), so the plan doesn't grow with the number of domains.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import blocks, policy
from lodestone.operators.lexicon import BROADCAST_TERMS, Lexicon, few
from lodestone.operators.retrieve import ranked, tokens
from lodestone.settings import Settings
from lodestone.sources.scratch import keep, place, splits
from lodestone.sources.versions import Table

#: The index of what has neither domain nor tenant.
BASE = "docs_index"
#: Postings of an index are dealt over so many tasks at least when they are written, so that one that holds most of the corpus isn't one task's.
DEAL = 64


class DomainLexicon(Lexicon):
    """Postings by index. A source may be in several indexes; what comes again replaces it in that index alone."""

    def __init__(self, spark: SparkSession, path: str, settings: Settings = Settings()) -> None:
        self.spark, self.settings = spark, settings
        self.table = Table(spark, path, ("index", "source"), {"postings": ("index",), "terms": ("index",)})

    def add(self, docs: DataFrame, txn: tuple[str, int] | None = None) -> int | None:
        """Indexes docs(id, text, source, index); a null source is the empty one, a null index the base."""
        rows = docs.select(F.coalesce("index", F.lit(BASE)).alias("index"), F.coalesce("source", F.lit("")).alias("source"), "id", "text")
        packs = self.packs(rows)
        dealt = lambda df, c: df.repartition(n := blocks.tasks(df), "index", F.pmod(F.xxhash64(c), F.lit(max(DEAL, n)))).sortWithinPartitions("index", "term")
        with splits(self.spark):
            return self.table.put({
                "docs": blocks.documents(packs),
                "keys": lambda held: held["docs"].groupBy("index", "source").agg(F.count("*").alias("n_docs"), F.sum("dl").alias("n_words")),
                "postings": dealt(packs.where("term IS NOT NULL").select("index", "source", "block", "term", "n", "places", "tfs"), "term"),
                "terms": lambda held: dealt(held["postings"].groupBy("index", "source", "term").agg(F.sum("n").alias("n")), "term"),
            }, txn=txn)

    def indexes(self) -> DataFrame:
        """(index, n, mean): the indexes that have documents, how many, and the mean number of words."""
        held = self.table.read("keys").groupBy("index").agg(F.sum("n_docs").cast("double").alias("n"), F.sum("n_words").alias("_w"))
        return held.where(F.col("n") > 0).select("index", "n", F.when(F.col("_w") > 0, F.col("_w") / F.col("n")).otherwise(1.0).alias("mean"))

    def domains(self) -> DataFrame:
        """(domain) of the indexes that are there, for routing."""
        named = self.table.read("keys").where(F.col("index").startswith(BASE + "_")).select(F.substring("index", len(BASE) + 2, 1 << 20).alias("domain"))
        return named.distinct()

    def resolve(self, wanted: DataFrame) -> DataFrame:
        """wanted(…, index) with the base in place of indexes that aren't there."""
        there = self.indexes().select("index", F.lit(True).alias("_there"))
        return wanted.join(few(there), "index", "left").withColumn("index", F.when(F.col("_there"), F.col("index")).otherwise(BASE)).drop("_there")

    def search(self, queries: DataFrame, k: int | None = None) -> DataFrame:
        """The k best documents of each of queries(query_id, query, index) in its index. Equal scores go by id; a question without words or an index without documents has no rows."""
        k = k or self.settings.top_k
        asked = keep(self.resolve(queries).select("query_id", "index", F.explode(F.array_distinct(tokens(F.col("query")))).alias("term")), "asked")
        words = asked.select("index", "term").distinct().where("term <> ''")
        df = self.table.read("terms").join(few(words), ["index", "term"]).groupBy("index", "term").agg(F.sum("n").alias("df"))
        idf = F.log(1.0 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        known = df.join(few(self.indexes()), "index").select("index", "term", "mean", idf.alias("idf"))
        weights = keep(asked.join(known, ["index", "term"]), "weights")
        weights = weights.where("idf > 0")
        held, docs = self.table.read("postings"), self.table.read("docs")
        if weights.count() <= BROADCAST_TERMS:
            wanted = weights.select("query_id", "index", "term", "idf", "mean", F.lit(1).alias("base"), F.lit(0).alias("extra"))
            n = self.table.read("keys").agg(F.sum("n_docs")).first()[0] or 0
            found = blocks.best(held.join(few(weights.select("index", "term").distinct()), ["index", "term"]), docs, wanted, k, n, self.settings)
            return ranked(found.drop("strict"), k, ["query_id"])
        each = blocks.exploded(held, docs).join(weights, ["index", "term"])
        total = each.groupBy("query_id", "id").agg(F.round(F.sum(F.col("idf") * self.weight(F.col("tf"), F.col("dl"), F.col("mean"))), 9).alias("score"))
        return ranked(total, k, ["query_id"])


def fan_out(questions: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """questions(domain, …) once for each domain to search: its own, then fallbacks; domain_idx is the place, index the name that the settings' map or the domain gives.

    Without any domain it is once, with a null searched domain, in the tenant's index or the base.
    """
    rows = questions.select("*", F.posexplode(policy.routed_domains(F.lower("domain"), [d for d in settings.domain_fallbacks if d])).alias("domain_idx", "searched"))
    own = T.namespace(BASE, F.col("tenant") if "tenant" in questions.columns else F.lit(None).cast("string"), F.col("searched"))
    mapped = F.create_map(*(F.lit(x) for pair in settings.domain_index_map.items() for x in pair)) if settings.domain_index_map else None
    return rows.withColumn("index", own if mapped is None else F.coalesce(F.try_element_at(mapped, "searched"), own))


def lexicon_of(docs: DataFrame, settings: Settings = Settings()) -> DomainLexicon:
    """An index of docs(id, text, source, index) in the shared folder."""
    made = DomainLexicon(docs.sparkSession, place(docs.sparkSession, "domain-lexicon"), settings)
    made.add(docs)
    return made
