"""Routing, policy and freshness of evidence."""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from lodestone.functions import text as T
from lodestone.settings import Settings


def route(query: Column, constraint: Column, preference: Column, indices: Sequence[str] = (), settings: Settings = Settings()) -> Column:
    """The question's domain: stated, preferred, named in the question, or best by keywords; else null.

    A keyword counts 1, an alias 2, the domain's name 2; of equal scores the domain declared
    first wins, and a score below the least is none.
    """
    low = F.lower(query)
    named = [F.when(F.contains(low, F.lit(d.lower())), F.lit(d)) for d in indices]
    hit = lambda words, weight: reduce(lambda a, b: a + b, [F.when(F.contains(low, F.lit(w.lower())), F.lit(weight)).otherwise(F.lit(0)) for w in words], F.lit(0))
    scores = [
        F.struct((hit(words, 1) + hit(settings.domain_aliases.get(d, []), 2) + hit([d], 2)).alias("score"), F.lit(-i).alias("order"), F.lit(d).alias("domain"))
        for i, (d, words) in enumerate(settings.domain_keywords.items())
    ]
    best = F.lit(None).cast("string")
    if scores:
        top = F.array_max(F.array(*scores))
        best = F.when(top["score"] >= settings.domain_min_keyword_hits, top["domain"])
    return F.coalesce(F.lower(T.falsy(constraint, "")), F.lower(T.falsy(preference, "")), *named, best)


def route_label(constraint: Column, preference: Column, domain: Column) -> Column:
    """Where the domain came from."""
    return (
        F.when(T.falsy(constraint, "").isNotNull(), "constraint").when(T.falsy(preference, "").isNotNull(), "preference").when(domain.isNotNull(), "keyword").otherwise("unknown")
    )


def routed_domains(domain: Column, fallbacks: Sequence[str]) -> Column:
    """The domain, then fallbacks that aren't it; one null if there is none."""
    found = F.array_distinct(F.filter(F.concat(F.array(domain), T.literals(list(fallbacks))), lambda d: d.isNotNull()))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(None).cast("string")))


def rule_matches(rule: dict, text: Column, source_type: Column, domain: Column) -> Column:
    """All conditions that the rule has. Its terms are held against the lower-case text as they are."""
    out = F.lit(True)
    if rule.get("domains"):
        out = out & F.coalesce(domain.isin(list(rule["domains"])), F.lit(False))
    if rule.get("source_types"):
        out = out & F.coalesce(source_type.isin(list(rule["source_types"])), F.lit(False))
    if rule.get("contains"):
        out = out & T.any_in(text, rule["contains"])
    if rule.get("not_contains"):
        out = out & ~T.any_in(text, rule["not_contains"])
    return out


def allowed(settings: Settings, text: str = "text", source_type: str = "source_type", domain: str = "domain") -> Column:
    """Whether a row passes blocklist, allowlist, type and domain lists, and the first rule that matches. Rows without a type or domain pass those lists."""
    low, kind, dom = F.lower(F.coalesce(F.col(text), F.lit(""))), F.lower(F.col(source_type)), F.lower(F.col(domain))
    out = ~T.any_in(low, [b.lower() for b in settings.blocklist])
    if settings.allowlist:
        out = out & T.any_in(low, [a.lower() for a in settings.allowlist])
    for value, allow, block in ((kind, settings.source_types_allow, settings.source_types_block), (dom, settings.domains_allow, settings.domains_block)):
        empty = F.coalesce(value == "", F.lit(True))
        if allow:
            out = out & (empty | F.coalesce(value.isin([a.lower() for a in allow]), F.lit(False)))
        if block:
            out = out & (empty | ~F.coalesce(value.isin([b.lower() for b in block]), F.lit(False)))
    verdict = F.lit(True)
    for rule in reversed(settings.rules):
        if (action := str(rule.get("action", "")).lower()) in ("allow", "deny"):
            verdict = F.when(rule_matches(rule, low, kind, dom), F.lit(action != "deny")).otherwise(verdict)
    return out & verdict


def apply_policy(rows: DataFrame, settings: Settings) -> DataFrame:
    return rows.where(allowed(settings))


def fresh(timestamp: Column, days: Column, now: float) -> Column:
    """Rows without a time stay, and all stay without a limit."""
    return days.isNull() | timestamp.isNull() | (timestamp >= F.lit(now) - days * 86400.0)


def freshness_days(preference: Column, constraint_days: Column, constraint: Column, settings: Settings = Settings()) -> Column:
    """Preference, then the constraint (0 counts as missing), then its other name, then the setting."""
    return F.coalesce(preference.cast("double"), T.falsy(constraint_days.cast("double"), 0.0), constraint.cast("double"), F.lit(settings.freshness_days).cast("double"))


def policy_signature(settings: Settings) -> str:
    """Sixteen hex digits that stand for the eight policy settings."""
    import hashlib

    held = {k: list(getattr(settings, k)) for k in ("blocklist", "allowlist", "source_types_allow", "source_types_block", "domains_allow", "domains_block", "rules")} | {"freshness_days": settings.freshness_days}
    return hashlib.sha256(json.dumps(held, sort_keys=True).encode()).hexdigest()[:16]


# -- policies that come with the questions -------------------------------------------------

LISTS = ("blocklist", "allowlist", "source_types_allow", "source_types_block", "domains_allow", "domains_block")
RULES = "array<struct<action:string,domains:array<string>,source_types:array<string>,contains:array<string>,not_contains:array<string>>>"
#: Where a question's own wishes may be: columns that are structs with any of the fields that are read.
SAID = ("constraints", "preferences")


def said(questions: DataFrame, where: str, name: str, kind: str) -> Column:
    """A field of a struct column; null if the column or the field isn't there."""
    held = questions.schema[where].dataType if where in questions.columns else None
    there = isinstance(held, StructType) and name in held.names
    return F.col(where)[name].cast(kind) if there else F.lit(None).cast(kind)


def said_list(questions: DataFrame, where: str, name: str) -> Column:
    """A list field, given as an array or as text with commas: trimmed, lower case, no empty entries."""
    held = questions.schema[where].dataType if where in questions.columns else None
    if not (isinstance(held, StructType) and name in held.names):
        return T.literals([])
    if not isinstance(held[name].dataType, ArrayType):
        return T.comma_list(said(questions, where, name, "string"))
    parts = F.transform(F.coalesce(said(questions, where, name, "array<string>"), T.literals([])), lambda x: F.lower(T.strip(x)))
    return F.filter(parts, lambda x: x.isNotNull() & (x != ""))


def said_rules(questions: DataFrame, where: str) -> Column:
    """Rules of a struct column; a rule may lack any field."""
    held = questions.schema[where].dataType if where in questions.columns else None
    there = isinstance(held, StructType) and "rules" in held.names
    return F.coalesce(F.from_json(F.to_json(F.col(where)["rules"]), RULES) if there else F.lit(None), F.array().cast(RULES))


def united(questions: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """questions with ``policy``: each list is the settings' entries, then the constraints', then the preferences'; so are the rules, of which those without a known action are left out.

    freshness_days is the preferences', else the constraints' (0 counts as missing), else theirs
    under the name freshness, else the settings'. A missing struct or field adds nothing.
    """
    lists = [F.concat(T.literals([v.strip().lower() for v in getattr(settings, n) if v.strip()]), *(said_list(questions, w, n) for w in SAID)).alias(n) for n in LISTS]
    own = F.from_json(F.lit(json.dumps([dict(r) for r in settings.rules])), RULES)
    rules = F.concat(own, *(said_rules(questions, w) for w in SAID))
    known = F.filter(rules, lambda r: F.lower(r["action"]).isin("allow", "deny"))
    days = freshness_days(said(questions, "preferences", "freshness_days", "double"), *(said(questions, "constraints", n, "double") for n in ("freshness_days", "freshness")), settings)
    return questions.withColumn("policy", F.struct(*lists, known.alias("rules"), days.alias("freshness_days")))


def allowed_by(policy: Column, text: str = "text", source_type: str = "source_type", domain: str = "domain") -> Column:
    """``allowed`` by a policy that lies in the row: lists and rules are arrays there, so questions of any policies share one plan."""
    low, kind, dom = (F.lower(F.coalesce(F.col(c), F.lit(""))) for c in (text, source_type, domain))
    some = lambda values: F.exists(values, lambda v: F.contains(low, v))
    of = lambda values: F.coalesce(values, T.literals([]))
    holds = lambda values, test: (F.size(of(values)) == 0) | test(of(values))

    def listed(value: Column, allow: Column, block: Column) -> Column:
        return (value == "") | (holds(allow, lambda v: F.array_contains(v, value)) & ~F.array_contains(block, value))

    def fits(r: Column) -> Column:
        return (
            holds(r["domains"], lambda v: F.array_contains(v, dom)) & holds(r["source_types"], lambda v: F.array_contains(v, kind))
            & holds(r["contains"], some) & holds(r["not_contains"], lambda v: ~some(v))
        )

    first = F.lower(F.get(F.filter(policy["rules"], fits), F.lit(0))["action"])
    out = ~some(policy["blocklist"]) & holds(policy["allowlist"], some)
    out = out & listed(kind, policy["source_types_allow"], policy["source_types_block"]) & listed(dom, policy["domains_allow"], policy["domains_block"])
    return out & (F.coalesce(first, F.lit("allow")) != "deny")


def apply_by_question(rows: DataFrame, policies: DataFrame, now: float) -> DataFrame:
    """rows(query_id, text, source_type, domain, timestamp) that the policy and the freshness of their question let pass; policies(query_id, policy). Rows of questions without a policy stay."""
    held = rows.join(policies.select("query_id", "policy"), "query_id", "left")
    ok = allowed_by(F.col("policy")) & fresh(F.col("timestamp"), F.col("policy.freshness_days"), now)
    return held.where(F.col("policy").isNull() | ok).drop("policy")


def signature_of(policy: Column) -> Column:
    """Sixteen hex digits that stand for a policy in a row."""
    return F.substring(F.sha2(F.to_json(policy).cast("binary"), 256), 1, 16)


def sub_queries(queries: Column, original: Column) -> Column:
    """Sub-questions without blanks; the question itself if none are left."""
    kept = F.filter(F.coalesce(queries, F.array().cast("array<string>")), lambda q: T.strip(F.coalesce(q, F.lit(""))) != "")
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(original))


def plan(queries: DataFrame, rules: Sequence[dict]) -> DataFrame:
    """queries plus (intent, hypotheses, queries) by the rules of domain packs: a rule fires on any trigger in the question, the last one that fires sets the intent."""
    low = F.lower(F.col("query"))
    fires = [(r, T.any_in(low, [t.lower() for t in r["triggers"]])) for r in rules if r.get("triggers")]
    none = F.array().cast("array<string>")
    intent = F.lit("general")
    for r, f in fires:
        intent = F.when(f & F.lit(bool(r.get("intent"))), F.lit(r.get("intent"))).otherwise(intent)
    gather = lambda key: F.concat(none, *(F.when(f, T.literals(r.get(key) or [])).otherwise(none) for r, f in fires))
    return queries.withColumns({"intent": intent, "hypotheses": gather("hypotheses"), "queries": sub_queries(gather("queries"), F.col("query"))})
