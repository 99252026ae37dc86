"""What the evidence graph says to each of many questions, in one plan.

A question brings the chunks of its evidence. Edges are cut down to the chunks of any question
before anything is counted, then counted for each question, and of each kind the first rows are
kept, ties by key. Every part has ``query_id``; a question without such edges has no rows there.

What is large goes through as few shuffles as can be, since all of them lie on disk until the end:
edges of chunks are dealt by chunk, those of claims by claim, relations by their first entity, and
what is grouped afterwards stays there. The entities that have relations are looked up first, and
sent to the edges where there are no more than FEW of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import models
from lodestone.operators.graph import Graph
from lodestone.settings import Settings
from lodestone.sources.scratch import keep

#: Entities that are broadcast at most.
FEW = 1 << 20
PARTS = ("claims", "entity_density", "relations", "relation_strength", "relation_conflicts", "evidence_scores", "paths", "subgraph", "signals")


def first(rows: DataFrame, n: int, by: tuple[str, ...], *order) -> DataFrame:
    """The first n rows of each group, with ``place``. Spark limits each task's rows before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def sent(names: DataFrame, label: str) -> DataFrame:
    """Names, stored, to be broadcast if they are no more than FEW."""
    held = keep(names, label)
    return F.broadcast(held) if held.count() <= FEW else held


def contexts(g: Graph, asked: DataFrame, named: DataFrame | None = None, settings: Settings = Settings()) -> dict[str, DataFrame]:
    """PARTS of the graph for asked(query_id, chunk_id). named(query_id, name): entities whose support in the whole graph is wanted as ``signals``."""
    n = settings.graph_top
    dealt = lambda df, *by: df.repartition(g.parts, *by) if g.parts else df.repartition(*by)
    asked = dealt(asked.select("query_id", "chunk_id").where("chunk_id IS NOT NULL"), "chunk_id").distinct()
    claims = g.chunk_claim.join(asked, "chunk_id")
    mentions = g.chunk_entity.join(asked, "chunk_id").select("query_id", "chunk_id", "name")
    against = dealt(g.contradicts.select(F.col("a").alias("claim_id"), F.col("b").alias("other")).union(g.contradicts.select("b", "a")), "claim_id").distinct()

    support = dealt(claims.select("query_id", "claim_id", "chunk_id").distinct(), "query_id", "claim_id").groupBy("query_id", "claim_id").agg(F.count("*").alias("support_count"))
    best = first(support, n, ("query_id",), F.desc("support_count"), "claim_id")
    opposed = against.join(best.select("claim_id").distinct(), "claim_id", "left_semi").groupBy("claim_id").agg(F.count("*").alias("contradict_count"))
    density = dealt(mentions.select("query_id", "name"), "query_id", "name").groupBy("query_id", "name").agg(F.count("*").alias("chunks"))  # edges are kept once

    pairs = g.relates.groupBy("src", "dst").agg(F.count("*").alias("predicates"))
    sources = sent(pairs.where("src IS NOT NULL").groupBy("src").agg(F.max("predicates").alias("_most")), "sources")

    # of a question and an entity all relations count alike: the first n are among those of its first n entities that have any
    # (the join is null-safe so that it wants no filter below the count, which is then made once)
    heads = density.join(sources, F.col("name").eqNullSafe(F.col("src"))).select("query_id", "src", F.col("chunks").alias("n"))
    related = first(heads, n, ("query_id",), F.desc("n"), "src").drop("place").join(g.relates, "src")
    relations = first(related.select("query_id", "src", "predicate", "dst", "n"), n, ("query_id",), F.desc("n"), "src", "predicate", "dst")
    strength = relations.groupBy("query_id", "src", "predicate", "dst").agg(F.sum("n").alias("strength")).where(F.col("strength") >= settings.strong_relation)
    conflicts = relations.groupBy("query_id", "src", "dst").agg(F.array_sort(F.collect_set("predicate")).alias("predicates")).where(F.size("predicates") > 1)

    # a chunk's counts don't depend on the question: they are made once for each chunk
    chunks = asked.select("chunk_id").distinct()
    held = g.chunk_claim.join(chunks, "chunk_id", "left_semi")
    by_claim = dealt(held.select("chunk_id", "claim_id"), "claim_id")
    opposing = dealt(by_claim.join(against, "claim_id").select("chunk_id", "other").distinct(), "chunk_id")
    scores = chunks.join(held.groupBy("chunk_id").agg(F.countDistinct("claim_id").alias("support")), "chunk_id", "left")
    scores = scores.join(g.chunk_entity.join(chunks, "chunk_id", "left_semi").groupBy("chunk_id").agg(F.count("*").alias("entities")), "chunk_id", "left")
    scores = scores.join(opposing.groupBy("chunk_id").agg(F.countDistinct("other").alias("contradictions")), "chunk_id", "left").fillna(0, ["support", "entities", "contradictions"])
    scores = scores.where("support > 0 OR entities > 0").withColumn("score", F.round(F.col("support") + 0.1 * F.col("entities") - 0.5 * F.col("contradictions"), 3))

    # likewise the first n paths are among those of the n chunks and entities whose greatest path comes first; only entities with relations have paths
    naming = g.claim_entity.withColumnRenamed("name", "src").join(sources.select("src"), "src", "left_semi")
    about = dealt(by_claim.join(naming, "claim_id").select("chunk_id", "src"), "chunk_id").groupBy("chunk_id", "src").agg(F.count("*").alias("claims"))
    most = about.join(sources, "src").withColumn("_n", F.col("claims") * F.col("_most"))
    ways = first(asked.join(most, "chunk_id"), n, ("query_id",), F.desc("_n"), "chunk_id", "src").drop("place")
    walks = ways.join(pairs, "src").select("query_id", "chunk_id", "src", "dst", (F.col("claims") * F.col("predicates")).alias("n"))

    out = {
        "claims": best.join(opposed, "claim_id", "left").fillna(0, ["contradict_count"]),
        "entity_density": first(density, n, ("query_id",), F.desc("chunks"), "name"),
        "relations": relations,
        "relation_strength": strength,
        "relation_conflicts": conflicts,
        "evidence_scores": asked.join(scores, "chunk_id"),
        "paths": first(walks, n, ("query_id",), F.desc("n"), "chunk_id", "src", "dst"),
        "subgraph": first(mentions.select("query_id", "chunk_id", "name"), settings.subgraph_pairs, ("query_id",), "chunk_id", "name"),
    }
    if named is not None:
        names = named.select("query_id", "name").distinct()
        whole = g.chunk_entity.join(sent(names.select("name").distinct(), "names"), "name", "left_semi").groupBy("name").agg(F.count("*").alias("chunks"))
        out["signals"] = names.join(whole, "name")
    return out


def contradicted(parts: dict[str, DataFrame]) -> DataFrame:
    """(query_id, claim_id, contradict_count) of a question's first claims that others contradict."""
    return parts["claims"].where("contradict_count > 0").select("query_id", "claim_id", "contradict_count")


def of_results(g: Graph, hits: DataFrame, settings: Settings = Settings()) -> dict[str, DataFrame]:
    """Contexts of results(query_id, id, text): their ids, and the entities that their texts name."""
    named = hits.select("query_id", F.explode(models.capitalised_entities(F.coalesce("text", F.lit("")))).alias("name"))
    return contexts(g, hits.select("query_id", F.col("id").alias("chunk_id")), named, settings)


def signals(parts: dict[str, DataFrame]) -> DataFrame:
    """(query_id, contradictions, conflicts, strong): what the judge weighs, for questions that have any of them."""
    count = lambda name, c: parts[name].groupBy("query_id").agg(F.count("*").alias(c))
    claims = contradicted(parts).groupBy("query_id").agg(F.count("*").alias("contradictions"))
    rows = claims.join(count("relation_conflicts", "conflicts"), "query_id", "full_outer").join(count("relation_strength", "strong"), "query_id", "full_outer")
    return rows.fillna(0, ["contradictions", "conflicts", "strong"])
