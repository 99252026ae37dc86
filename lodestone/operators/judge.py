"""Confidence, answers and diagnostics of answered questions, as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.settings import Settings


def penalize_contradictions(confidence: Column, n: Column, s: Settings = Settings()) -> Column:
    less = confidence * (1.0 - F.least(F.lit(s.contradiction_penalty_max), s.contradiction_penalty * n))
    return F.when(n > 0, F.least(less, F.lit(s.contradiction_cap))).otherwise(confidence)


def penalize_conflicts(confidence: Column, n: Column, s: Settings = Settings()) -> Column:
    less = confidence * (1.0 - F.least(F.lit(s.conflict_penalty_max), s.conflict_penalty * n))
    return F.when(n > 0, F.greatest(F.lit(0.0), less)).otherwise(confidence)


def boost_relations(confidence: Column, strong: Column, contradictions: Column, s: Settings = Settings()) -> Column:
    more = F.least(F.lit(1.0), confidence + F.least(F.lit(s.relation_boost_max), s.relation_boost * strong))
    return F.when((contradictions == 0) & (strong > 0), more).otherwise(confidence)


def confidence(base: Column, contradictions: Column, conflicts: Column, strong: Column, s: Settings = Settings()) -> Column:
    """The three adjustments in their order."""
    return boost_relations(penalize_conflicts(penalize_contradictions(base, contradictions, s), conflicts, s), strong, contradictions, s)


def notes(note: Column, contradictions: Column, conflicts: Column, strong: Column) -> Column:
    """Notes of the adjustments made, behind the judge's own."""
    said = F.array(
        T.falsy(note, ""),
        F.when(contradictions > 0, F.format_string("confidence adjusted for %d contradictions", contradictions)),
        F.when(conflicts > 0, F.format_string("confidence adjusted for %d relation conflicts", conflicts)),
        F.when((contradictions == 0) & (strong > 0), F.format_string("confidence boosted for %d relations", strong)),
    )
    return F.array_join(F.filter(said, lambda x: x.isNotNull()), "; ")


def judge_ladder(response: Column, failed: Column, top_ids: Column, s: Settings = Settings()) -> Column:
    """struct<confidence, trusted_ids, branch> of a judge's text: its JSON, or fallbacks for other text and for errors, which trust the first three."""
    body = T.json_body(response)
    parsed = F.from_json(body, "confidence double, trusted_ids array<string>")
    good = body.isNotNull() & ~failed
    value = F.when(good, parsed["confidence"]).when(failed | response.isNull(), F.lit(s.judge_error)).otherwise(F.lit(s.judge_non_json))
    return F.struct(
        value.alias("confidence"),
        F.when(good, F.coalesce(parsed["trusted_ids"], F.array().cast("array<string>"))).otherwise(F.slice(top_ids, 1, 3)).alias("trusted_ids"),
        F.when(good, "json").when(failed | response.isNull(), "error").otherwise("non_json").alias("branch"),
    )


def synthesis_ladder(response: Column, naturalized: Column, status: Column, texts: Column, authors: Column, gap: Column, judged: Column, s: Settings = Settings()) -> Column:
    """struct<answer, confidence, trace, outcome>: a JSON answer, clamped if natural; a second free-text pass; sentences of the evidence.

    status is ok, timeout or error; naturalized is the second pass's text or null.
    """
    body = T.json_body(response)
    parsed = F.from_json(body, "answer string, confidence double, explain_trace string")
    first = T.clamp_answer(parsed["answer"])
    second = T.clamp_answer(F.coalesce(naturalized, F.lit("")))
    ok = (status == "ok") & body.isNotNull()
    by_json, by_second = ok & T.natural(first), T.natural(second)
    trace = (
        F.when(by_json, F.coalesce(parsed["explain_trace"], F.lit(""))).when(ok & by_second, "synthesis_naturalized").when(ok, "synthesis_fallback_formatted")
        .when(status == "timeout", "synthesis_timeout").when(status == "error", "synthesis_error").otherwise("synthesis_non_json")
    )
    return F.struct(
        F.when(by_json, first).when(by_second, second).otherwise(T.fallback_answer(texts, authors, gap)).alias("answer"),
        F.coalesce(F.when(ok, parsed["confidence"]), judged, F.lit(s.synthesis_confidence)).alias("confidence"),
        trace.alias("explain_trace"),
        F.when(ok, "success").when(status.isin("timeout", "error"), status).otherwise("non_json").alias("outcome"),
    )


def agent_failure(agent: str, d: Column) -> Column:
    """Tag of an agent that was asked and never succeeded: timeout before error before no hits."""
    bad = (d["attempted"] > 0) & (d["ok"] == 0)
    kind = F.when(d["timeout"] > 0, f"{agent}_timeout").when(d["error"] > 0, f"{agent}_error").otherwise(f"{agent}_zero_hits")
    return F.when(bad, kind)


def failure_tags(q: dict[str, Column], s: Settings = Settings()) -> Column:
    """Ordered tags. q: domain, n_raw, n_normal, vector, lexical, structured, lexical_author (structs of counts), n_domains, n_rows, author_gap, explain_trace, top_score."""
    has_domain = T.falsy(q["domain"], "").isNotNull()
    tags = [
        F.when(~has_domain, "no_domain"),
        F.when((q["n_raw"] > 0) & (q["n_normal"] == 0), "policy_blocked"),
        *(agent_failure(a, q[a]) for a in ("vector", "lexical", "structured", "lexical_author") if a in q),
        F.when(has_domain & (q["n_domains"] > 1), "cross_domain_conflict"),
        F.when(q["n_rows"] == 0, "no_results"),
        F.when(q["author_gap"], "author_gap"),
        F.when(q["explain_trace"] == "synthesis_timeout", "synthesis_timeout").when(q["explain_trace"].isin("synthesis_error", "synthesis_unavailable"), "synthesis_error"),
        F.when(q["n_rows"] < s.min_results, "low_result_count"),
        F.when((q["n_rows"] > 0) & (q["top_score"] < s.min_top_score), "low_top_score"),
    ]
    return F.filter(F.array(*tags), lambda t: t.isNotNull())


# These tags forbid the confidence floor.
SEVERE = ("no_results", "vector_timeout", "vector_error", "lexical_timeout", "lexical_error", "structured_timeout", "structured_error", "synthesis_timeout", "synthesis_error")


def floored(value: Column, rows: Column, has_authors: Column, gap: Column, top_author: Column, top_score: Column, tags: Column, s: Settings = Settings()) -> Column:
    """The confidence from which the risk is taken: lifted to a floor where the best row is the author's."""
    strong = F.coalesce(top_score >= s.floor_top_score, F.lit(False))
    good = (rows > 0) & has_authors & ~gap & top_author & strong & ~F.arrays_overlap(tags, T.literals(SEVERE))
    return F.when(good, F.greatest(value, F.lit(s.floor_confidence))).otherwise(value)


def hallucination_risk(value: Column, n_provenance: Column, tags: Column, gap: Column) -> Column:
    more = lambda c, x: F.when(c, F.lit(x)).otherwise(F.lit(0.0))
    return T.clamp01(1.0 - value + more(n_provenance == 0, 0.2) + more(F.array_contains(tags, "low_top_score"), 0.1) + more(gap, 0.1))


def evidence_coverage(n_provenance: Column, n_rows: Column, s: Settings = Settings()) -> Column:
    return F.least(F.lit(1.0), n_provenance / F.greatest(F.lit(1), F.least(F.lit(s.max_evidence), n_rows)))
