"""Several configurations in one plan: settings that lie in the question's row."""

from __future__ import annotations

from dataclasses import fields
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import policy
from lodestone.settings import Settings

#: Settings that may differ from configuration to configuration, besides policy lists, rules and freshness, which the policy in the row has.
VARY = (
    "top_k", "rerank_top_k", "max_evidence", "min_results", "min_top_score", "floor_confidence", "floor_top_score", "judge_non_json", "contradiction_cap", "contradiction_penalty",
    "contradiction_penalty_max", "relation_boost", "relation_boost_max", "conflict_penalty", "conflict_penalty_max",
)
POLICY = (*policy.LISTS, "rules", "freshness_days")


class Row:
    """Stands for Settings where columns are made: what may differ is a field of the row, the rest is the base's value."""

    def __init__(self, base: Settings) -> None:
        self.base = base

    def __getattr__(self, name: str):
        return F.col(f"settings.{name}") if name in VARY else getattr(self.base, name)


def spread(questions: DataFrame, configs: dict[str, Settings]) -> DataFrame:
    """questions(query_id, query, …) once for each configuration: query_id becomes (config, query_id), settings and policy come with it.

    A ValueError names a setting that differs but can't: it belongs to what all configurations share.
    """
    if not configs:
        raise ValueError("no configurations")
    base = next(iter(configs.values()))
    for name, s in configs.items():
        other = [f.name for f in fields(Settings) if f.name not in (*VARY, *POLICY) and getattr(s, f.name) != getattr(base, f.name)]
        if other:
            raise ValueError(f"{name} differs in {', '.join(other)}: run it by itself")
    kinds = {f.name: "int" if f.type in ("int", int) else "double" for f in fields(Settings) if f.name in VARY}

    def one(name: str, s: Settings) -> DataFrame:
        held = F.struct(*(F.lit(getattr(s, v)).cast(kinds[v]).alias(v) for v in VARY))
        return policy.united(questions, s).withColumns({"query_id": F.struct(F.lit(name).alias("config"), "query_id"), "settings": held})

    return reduce(DataFrame.unionByName, (one(*c) for c in configs.items()))


def overlap(a: Column, b: Column) -> Column:
    """Share of the words of a that b has; 0 if a has none."""
    words = F.array_distinct(T.query_tokens(F.coalesce(a, F.lit(""))))
    return F.when(F.size(words) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(words, T.query_tokens(F.coalesce(b, F.lit(""))))) / F.size(words))


def runs(answers: DataFrame, errors: DataFrame | None = None, chars: int = 400, snippets: int = 5) -> DataFrame:
    """Rows as an ablation writes them, one for each question and configuration; errors(query_id, query, error) are rows that have nothing else.

    faithfulness and relevance stand in for a model's judgement: how much of the answer the
    evidence has, how much of the question the answer has.
    """
    said = F.slice("results", 1, snippets)
    snippet = F.transform(said, lambda r: F.struct(r["source"].alias("source"), F.substring(r["text"], 1, chars).alias("text")))
    rows = answers.select(
        F.col("query_id.config").alias("base_url"), F.col("query_id.query_id").alias("query_id"), "query", "answer", "confidence", "hallucination_risk", "retrieval_failures", "author_gap",
        F.transform("results", lambda r: r["source"]).alias("sources"), snippet.alias("evidence"),
        overlap(F.col("answer"), F.array_join(F.transform(said, lambda r: r["text"]), " ")).alias("faithfulness"), overlap(F.col("query"), F.col("answer")).alias("relevance"),
        F.lit(None).cast("string").alias("error"),
    )
    if errors is None:
        return rows
    bad = errors.select(F.col("query_id.config").alias("base_url"), F.col("query_id.query_id").alias("query_id"), "query", "error")
    return rows.unionByName(bad, allowMissingColumns=True)


def write(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines; what is null is left out, so an error's row has its question and its error alone."""
    rows.write.mode("error").json(path)
