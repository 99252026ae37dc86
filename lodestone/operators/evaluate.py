"""Scores of recorded runs against labelled questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T


def expected(sources: Column) -> Column:
    """Distinct base names, none empty."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(sources, F.array().cast("array<string>")), T.base_name), lambda s: s != ""))


def recall_at(k: int, found: Column, wanted: Column) -> Column:
    """Distinct expected sources among the first k, of those expected; 0 if none are."""
    want = expected(wanted)
    got = F.transform(F.slice(F.coalesce(found, F.array().cast("array<string>")), 1, k), T.base_name)
    return F.when(F.size(want) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(want, got)) / F.size(want))


def hit_rate_at(k: int, found: Column, wanted: Column) -> Column:
    got = F.transform(F.slice(F.coalesce(found, F.array().cast("array<string>")), 1, k), T.base_name)
    return F.coalesce(F.arrays_overlap(expected(wanted), got), F.lit(False)).cast("double")


def score_run(runs: DataFrame, truth: DataFrame, k: int = 5) -> DataFrame:
    """(config, n, errors, recall, hit_rate, lexical_overlap, confidence) for each base_url, and faithfulness and relevance where runs have them.

    A run with an error counts in n and errors only; without a label it has no recall; without a
    reference answer no overlap. Labels are few against runs and are joined by query.
    """
    held = runs.join(truth, "query", "left")
    ok = F.col("error").isNull()
    labelled = ok & F.col("expected_sources").isNotNull() & (F.size("expected_sources") > 0)
    referenced = ok & (F.coalesce("reference_answer", F.lit("")) != "")
    return held.groupBy(F.col("base_url").alias("config")).agg(
        F.count("*").alias("n"),
        F.count_if(~ok).alias("errors"),
        F.avg(F.when(labelled, recall_at(k, F.col("sources"), F.col("expected_sources")))).alias("recall"),
        F.avg(F.when(labelled, hit_rate_at(k, F.col("sources"), F.col("expected_sources")))).alias("hit_rate"),
        F.avg(F.when(referenced, T.lexical_overlap(F.coalesce("answer", F.lit("")), F.col("reference_answer")))).alias("lexical_overlap"),
        F.avg(F.when(ok, F.col("confidence"))).alias("confidence"),
        *(F.avg(F.when(ok, F.col(c))).alias(c) for c in ("faithfulness", "relevance") if c in runs.columns),
    )


def markdown(scores: DataFrame, k: int = 5) -> str:
    """The report of a few configurations: a table whose lines Spark formats. A score that is missing reads n/a."""
    # The report's title and columns.
    columns = {"config": "config", "n": "n", "errors": "errors", "recall": f"recall@{k}", "hit_rate": f"hit_rate@{k}", "lexical_overlap": "lexical_overlap", "faithfulness": "faithfulness", "relevance": "relevance", "confidence": "confidence"}
    kinds = dict(scores.dtypes)

    def cell(name: str) -> Column:
        if name not in kinds:
            return F.lit("n/a")
        value = F.format_string("%.3f", F.col(name)) if kinds[name] == "double" else F.col(name).cast("string")
        return F.when(F.col(name).isNull(), "n/a").otherwise(value)

    row = lambda cells: f"| {' | '.join(cells)} |"
    body = scores.orderBy("config").select(F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, columns)), F.lit(" |")).alias("line"))
    return "\n".join(["# Evaluation report", "", row(columns.values()), row("---" for _ in columns), *(r["line"] for r in body.collect()), ""])
