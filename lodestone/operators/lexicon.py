"""A stored inverted index: postings of terms in blocks of documents, searched block by block.

A source's documents are dealt into blocks of about BLOCK of them. ``postings`` has a row for each
term of a block: the documents' places in the block and the term's counts, packed (``blocks``), their
number, the greatest count and the shortest document, which bound the term's weight there whatever
the corpus's statistics become. They lie in BUCKETS folders by term, sorted by term and block. ``docs``
has a row for each document, ``keys`` the number and words of each source's documents. All are datasets
of one ``Table``: a source that comes again, or is deleted, touches no other source's blocks.

A search reads the folders of its terms only. Unless told otherwise it sends each posting once to its
block's group, where all questions are weighed together: its cost doesn't grow with the number of
questions and documents that meet. With more than BROADCAST_TERMS terms of questions, or with
``whole=0``, it goes block by block instead. The bounds of a question's terms are added up for
each block, without its postings; the documents of the best blocks are weighed first. The last of
the k best so far then decides what else is read: blocks whose bound doesn't reach it are skipped,
and so are the terms that together can't reach it (the most frequent ones, with the longest lists),
except for documents that the other terms bring near enough. Since a document's terms are all in
its block, what is left out can't be among the k best. BM25 is this engine's own
definition of a lexical score (k1 1.2, b 0.75, words of letters and digits in lower case).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators import blocks
from lodestone.operators.retrieve import query_terms, ranked, tokens
from lodestone.settings import Settings
from lodestone.sources.scratch import keep, place, splits
from lodestone.sources.versions import Table

BUCKETS = 64
BLOCK = 512
#: Blocks of a question that are weighed before the others are looked at.
FIRST = 4
#: So many rows of questions and terms may be broadcast.
BROADCAST_TERMS = 1_000_000
#: Times k: documents of a question whose scores are completed before the others'.
NEAREST = 8
SLACK = 1e-6
#: Postings of a search's questions for each shuffle partition, up to which all are read. A posting takes some bytes of the shuffle and its question some nanoseconds, the rounds that skip some take a row for each question and block.
WHOLE = 1 << 40


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


class Lexicon:
    def __init__(self, spark: SparkSession, path: str, settings: Settings = Settings()) -> None:
        self.spark, self.settings = spark, settings
        self.table = Table(spark, path, ("source",), {"postings": ("bucket",)})

    # writing

    def add(self, docs: DataFrame, txn: tuple[str, int] | None = None) -> int | None:
        """Indexes docs(id, text, source); what their sources had before no longer counts. A null source is the empty one."""
        rows = docs.select(F.lit("").alias("index"), F.coalesce("source", F.lit("")).alias("source"), "id", "text")
        packs = self.packs(rows)
        postings = packs.where("term IS NOT NULL").select("source", "block", "term", "n", "most_tf", "least_dl", "places", "tfs", bucket(F.col("term")).alias("bucket"))
        with splits(self.spark):
            return self.table.put({
                "docs": blocks.documents(packs).drop("index"),
                "keys": lambda held: held["docs"].groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("dl").alias("n_words")),
                "postings": dealt(postings).sortWithinPartitions("bucket", "term", "source", "block"),
            }, txn=txn)

    def packs(self, rows: DataFrame) -> DataFrame:
        """rows(index, source, id, text) in blocks, packed."""
        sizes = keep(rows.groupBy("index", "source").agg(F.count("*").alias("_n")), "sizes")
        placed = rows.join(few(sizes), ["index", "source"]).withColumn("block", F.pmod(F.xxhash64("id"), F.ceil(F.col("_n") / BLOCK).cast("long")))
        return keep(blocks.packed(placed, sizes.agg(F.sum("_n")).first()[0] or 0), "packs")

    def delete(self, source: str) -> int:
        return self.table.delete(source)

    # reading

    def statistics(self) -> tuple[float, float]:
        """(documents, their mean length)."""
        n, words = self.table.read("keys").agg(F.sum("n_docs"), F.sum("n_words")).first()
        return float(n or 0), (words / n if n and words else 1.0)

    def rows(self, name: str, terms: DataFrame) -> DataFrame:
        """The terms' rows of postings, from their folders alone. A list of the folders, BUCKETS at most, goes into the plan."""
        folders = [r[0] for r in terms.select(bucket(F.col("term"))).distinct().collect()]
        return self.table.read(name).where(F.col("bucket").isin(folders))

    def postings(self, terms: DataFrame) -> DataFrame:
        """(source, block, term, id, tf, dl) of terms(term)."""
        packs = self.rows("postings", terms).join(few(terms.select("term").distinct()), "term", "left_semi").withColumn("index", F.lit(""))
        return blocks.exploded(packs, self.documents()).drop("index")

    def documents(self) -> DataFrame:
        return self.table.read("docs").withColumn("index", F.lit(""))

    def best(self, weights: DataFrame, k: int, n: float, mean: float, authors: DataFrame | None = None, sources: DataFrame | None = None) -> DataFrame:
        """``blocks.best`` of weights(query_id, term, idf, …), within the sources, if there are any."""
        flags = [F.col(c) if c in weights.columns else F.lit(v).alias(c) for c, v in (("base", 1), ("extra", 0))]
        held, docs = self.rows("postings", weights).join(few(weights.select("term").distinct()), "term", "left_semi"), self.table.read("docs")
        if sources is not None:
            held, docs = (df.join(few(sources), "source", "left_semi") for df in (held, docs))
        asked = weights.select("query_id", F.lit("").alias("index"), "term", "idf", F.lit(mean).alias("mean"), *flags)
        return blocks.best(held.withColumn("index", F.lit("")), docs.withColumn("index", F.lit("")), asked, k, n, self.settings, authors)

    def weight(self, tf: Column, dl: Column, mean: float) -> Column:
        k1, b = self.settings.bm25_k1, self.settings.bm25_b
        return tf * (k1 + 1.0) / (tf + k1 * (1.0 - b + b * dl / mean))

    def weighted(self, asked: DataFrame, n: float, mean: float) -> DataFrame:
        """asked(query_id, term, …) with idf, and the most that the term can weigh in a document; terms that no document has are left out."""
        held = self.rows("postings", asked).select("term", "n", "most_tf", "least_dl").join(few(asked.select("term").distinct()), "term", "left_semi")
        df = held.groupBy("term").agg(F.sum("n").alias("df"), F.max(self.weight(F.col("most_tf"), F.col("least_dl"), mean)).alias("_most"))
        idf = F.log(1.0 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        return keep(asked.join(df.select("term", "df", idf.alias("idf"), (idf * F.col("_most")).alias("most")), "term"), "weights")

    def scores(self, weights: DataFrame, chosen: DataFrame, mean: float) -> DataFrame:
        """(query_id, id, score) of all documents of chosen(query_id, source, block) with a term of the question."""
        wanted = chosen.join(weights, "query_id")
        each = self.postings(weights).join(wanted, ["term", "source", "block"])
        part = F.col("idf") * self.weight(F.col("tf"), F.col("dl"), mean)
        # rounded: the order of a sum's terms isn't fixed, and equal scores must tie
        return each.groupBy("query_id", "id").agg(F.round(F.sum(part), 9).alias("score"))

    def search(self, queries: DataFrame, k: int | None = None, whole: int = WHOLE) -> DataFrame:
        """The k best documents of each of queries(query_id, query).

        How many postings the questions have is known from the blocks: up to ``whole`` for each
        shuffle partition, one pass over them costs less than the rounds that skip some.
        """
        k = k or self.settings.top_k
        asked = keep(query_terms(queries), "asked")
        n, mean = self.statistics()
        weights = self.weighted(asked, n, mean)
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        if (weights.agg(F.sum("df")).first()[0] or 0) <= whole * parts and weights.count() <= BROADCAST_TERMS:
            return ranked(self.best(weights, k, n, mean).drop("strict"), k, ["query_id"])
        bound = F.col("idf") * self.weight(F.col("most_tf"), F.col("least_dl"), mean)
        bounds = self.rows("postings", weights).drop("places", "tfs").join(few(weights), "term").groupBy("query_id", "source", "block").agg(F.sum(bound).alias("bound"))
        bounds = keep(bounds, "bounds")
        order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "source", "block")
        best = keep(bounds.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= FIRST).drop("_n"), "first")
        first = keep(self.scores(weights, best.drop("bound"), mean), "first-scores")
        last = ranked(first, k, ["query_id"]).where(F.col("rank") == k).select("query_id", F.col("score").alias("_last"))
        rest = bounds.join(best.select("query_id", "source", "block"), ["query_id", "source", "block"], "left_anti").join(few(last), "query_id", "left")
        rest = rest.where(F.col("bound") >= F.coalesce("_last", F.lit(0.0)) - SLACK).select("query_id", "source", "block")
        return ranked(first.union(self.others(weights, rest, last, k, mean)), k, ["query_id"])

    def others(self, weights: DataFrame, blocks: DataFrame, last: DataFrame, k: int, mean: float) -> DataFrame:
        """(query_id, id, score) of the documents of blocks(query_id, source, block) that may reach last(query_id, _last)."""
        upto = Window.partitionBy("query_id").orderBy("most", "term").rowsBetween(Window.unboundedPreceding, 0)
        parts = weights.withColumn("_sum", F.sum("most").over(upto)).join(few(last), "query_id", "left")
        parts = keep(parts.withColumn("_slight", F.col("_sum") < F.coalesce("_last", F.lit(0.0)) - SLACK), "parts")
        slight, telling = parts.where("_slight"), parts.where("NOT _slight")
        part = F.col("idf") * self.weight(F.col("tf"), F.col("dl"), mean)
        each = self.postings(telling).join(few(telling.select("query_id", "term", "idf")), "term").join(few(blocks), ["query_id", "source", "block"], "left_semi")
        some = each.groupBy("query_id", "id").agg(F.sum(part).alias("_part"))
        open_ = slight.groupBy("query_id").agg(F.max("_sum").alias("_open"), F.max("_last").alias("_last"))
        near = some.join(few(open_), "query_id", "left").where(F.coalesce(F.col("_part") + F.col("_open") >= F.col("_last") - SLACK, F.lit(True)))
        near = keep(near.select("query_id", "id", "_part", "_open"), "near")

        def full(docs: DataFrame) -> DataFrame:
            wanted = docs.join(few(slight.select("query_id", "term", "idf")), "query_id").select("query_id", "id", "term", "idf")
            more = self.postings(slight).join(few(wanted), ["term", "id"]).groupBy("query_id", "id").agg(F.sum(part).alias("_more"))
            return docs.join(more, ["query_id", "id"], "left").select("query_id", "id", F.round(F.col("_part") + F.coalesce("_more", F.lit(0.0)), 9).alias("score"))

        # the nearest documents first: they raise the mark for the others
        nearest = keep(ranked(near, NEAREST * k, ["query_id"], "_part"), "nearest")
        sure = keep(full(nearest), "sure")
        mark = ranked(sure, k, ["query_id"]).where(F.col("rank") == k).select("query_id", F.col("score").alias("_mark"))
        left = near.join(few(mark), "query_id", "left").where(F.coalesce(F.col("_part") + F.coalesce("_open", F.lit(0.0)) >= F.col("_mark") - SLACK, F.lit(True)))
        left = keep(left.join(nearest.select("query_id", "id"), ["query_id", "id"], "left_anti").select("query_id", "id", "_part"), "left")
        return sure.union(full(left))

    def author_search(self, queries: DataFrame, k: int | None = None) -> DataFrame:
        """The k best documents whose source contains an author of the question (case counts); queries(query_id, query, authors, required).

        A required term adds its score once more and one of them must occur; a question whose
        required terms leave nothing is answered without them.
        """
        k = k or self.settings.author_top_k
        needed = queries.select("query_id", F.explode(F.array_distinct(tokens(F.array_join("required", " ")))).alias("term"), F.lit(0).alias("base"), F.lit(1).alias("extra"))
        both = query_terms(queries).withColumns({"base": F.lit(1), "extra": F.lit(0)}).union(needed)
        asked = keep(both.groupBy("query_id", "term").agg(F.max("base").alias("base"), F.max("extra").alias("extra")), "asked")
        n, mean = self.statistics()
        weights = self.weighted(asked, n, mean)
        of = containing(self.table.read("keys").select("source").distinct(), queries.select("query_id", F.explode("authors").alias("name")))
        if weights.count() <= BROADCAST_TERMS:
            found = keep(self.best(weights, k, n, mean, queries.select("query_id", "authors"), of.select("source").distinct()), "author-scores")
            strict, loose = found.where("strict"), found.where("NOT strict")
            both = strict.union(loose.join(strict.select("query_id").distinct(), "query_id", "left_anti")).drop("strict")
            return ranked(both.join(self.table.read("docs").select("id", "source"), "id"), k, ["query_id"])
        wanted = weights.join(of, "query_id")
        each = self.postings(weights).join(few(wanted), ["term", "source"])
        part = F.col("idf") * self.weight(F.col("tf"), F.col("dl"), mean)
        total = each.groupBy("query_id", "id", "source").agg(
            F.round(F.sum(F.when(F.col("base") == 1, part)), 9).alias("score"), F.round(F.sum(F.when(F.col("extra") == 1, part)), 9).alias("required_score"),
        )
        total = keep(total, "author-scores")
        strict = total.where(F.col("required_score").isNotNull()).withColumn("score", F.round(F.coalesce("score", F.lit(0.0)) + F.col("required_score"), 9)).drop("required_score")
        loose = total.where(F.col("score").isNotNull()).drop("required_score").join(strict.select("query_id").distinct(), "query_id", "left_anti")
        return ranked(strict.unionByName(loose), k, ["query_id"])


def dealt(rows: DataFrame) -> DataFrame:
    """Rows by folder; where there are more partitions than folders, a folder's blocks are dealt over several, so that a term of all documents isn't one task's."""
    n = blocks.tasks(rows)
    return rows.repartition(n, "bucket", F.pmod(F.xxhash64("source", "block"), F.lit(1 + n // BUCKETS)))


def few(rows: DataFrame) -> DataFrame:
    """Broadcast where there are at most BROADCAST_TERMS; else a shuffled join."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_TERMS else rows


def with_documents(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """Hits with the columns of docs(id, …). There are k hits of a question at most: they are sent to the documents, so that no text is shuffled."""
    return few(keep(hits, "hits")).join(docs, "id")


def containing(sources: DataFrame, names: DataFrame) -> DataFrame:
    """(query_id, source) where the source contains a name: substrings of the sources, as long as some name, meet the names by equality."""
    sizes = [r[0] for r in names.select(F.length("name")).distinct().collect() if r[0]]  # as many as names have lengths
    if not sizes:
        return names.select("query_id", F.col("name").alias("source")).limit(0)
    lengths = F.filter(F.array(*map(F.lit, sorted(sizes))), lambda n: n <= F.length("source"))
    cuts = F.flatten(F.transform(lengths, lambda n: F.transform(F.sequence(F.lit(1), F.length("source") - n + 1), lambda i: F.substring(F.col("source"), i, n))))
    parts = sources.select("source", F.explode(F.array_distinct(cuts)).alias("name"))
    return parts.join(names, "name").select("query_id", "source").distinct()


_built: dict[tuple, Lexicon] = {}


def index_of(docs: DataFrame, settings: Settings = Settings(), key: tuple | None = None) -> Lexicon:
    """An index of docs(id, text, source) in the shared folder. With a key it is built once in this application: the key must change with the rows."""
    spark = docs.sparkSession
    whole = key and (spark.sparkContext.applicationId, *key)
    if whole and whole in _built:
        return _built[whole]
    made = Lexicon(spark, place(spark, "lexicon"), settings)
    made.add(docs)
    if whole:
        _built[whole] = made
    return made
