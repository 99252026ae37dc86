"""Answering a batch of questions as one plan, from corpus to answers with provenance."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.functions import models
from lodestone.functions import text as T
from lodestone.operators import context, domains, evidence, judge, lexicon, policy, retrieve, sweep, vectors
from lodestone.operators.chunk import chunks
from lodestone.operators.graph import Graph
from lodestone.settings import Settings
from lodestone.sources import store
from lodestone.sources.answers import AnswerCache
from lodestone.sources.scratch import keep, place


CHUNK = ("id", "text", "source", "timestamp", "source_type", "domain", "offset_start", "offset_end")
#: What an answer is, besides its query_id and query.
ANSWER = (
    "intent string, domain string, domain_source string, answer string, provenance array<struct<id:string,source:string,offset_start:int,offset_end:int>>, confidence double, author_gap boolean, "
    "retrieval_failures array<string>, hallucination_risk double, evidence_coverage double, n_rows int, results array<struct<id:string,source:string,text:string>>, explain_trace string, notes string"
)
#: Arrival of a second round's hits: behind all of the first one's.
SECOND = 1 << 20


class Engine:
    """What a service would call, over tables: questions come as a DataFrame and so do answers."""

    #: Schema of what answer returns besides query_id and query.
    kind = ANSWER

    def __init__(
        self, settings: Settings = Settings(), packs: list[dict] | None = None, now: float = 0.0, embed: Callable[[Column], Column] | None = None,
        judge: Callable[[Column, Column], Column] | None = None, write: Callable[[Column, Column], Column] | None = None,
    ) -> None:
        """embed makes a text's vector; with it the vector agent is asked too.

        judge makes a judge's response of a question and its evidence, an array of struct<id, source,
        text>; null where it failed. write makes struct<status, response, naturalized> of a question
        and the rows that the judge trusts: status is ok, timeout or error.
        """
        self.settings, self.packs, self.now, self.embed, self.judge, self.write = settings, packs or [], now, embed, judge, write

    def ingest(self, docs: DataFrame) -> DataFrame:
        """Chunks of docs(text, source, source_type, domain, timestamp)."""
        return chunks(docs, self.settings)

    def plan(self, questions: DataFrame) -> DataFrame:
        """questions(query_id, query) with sub-questions, domain and its label.

        They may bring columns constraints and preferences, structs with a domain, policy lists,
        rules and freshness (``policy.united``); constraint_domain and preference_domain go before
        the structs' domain.
        """
        rules = [h for p in self.packs for h in p.get("planner_hints") or []]
        held = questions
        for where in policy.SAID:
            c = f"{where[:-1]}_domain"
            held = held if c in held.columns else held.withColumn(c, policy.said(questions, where, "domain", "string"))
        if "policy" not in held.columns and any(where in held.columns for where in policy.SAID):
            held = policy.united(held, self.settings)
        planned = policy.plan(held, rules)
        domain = policy.route(F.col("query"), F.col("constraint_domain"), F.col("preference_domain"), (), self.settings)
        planned = planned.withColumn("domain", domain)
        return planned.withColumn("domain_source", policy.route_label(F.col("constraint_domain"), F.col("preference_domain"), F.col("domain")))

    def asked(self, planned: DataFrame) -> DataFrame:
        """(query_id, query, authors, terms): whom of the packs' authors a question names, and its terms."""
        names = sorted({a for p in self.packs for a in p.get("authors") or []})
        stop = [w for p in self.packs for w in p.get("author_stopwords") or []]
        rows = planned.select("query_id", "query", T.author_mentions(F.col("query"), names, stop).alias("authors") if names else F.array().cast("array<string>").alias("authors"))
        return rows.withColumn("terms", T.query_terms(F.col("query"), F.col("authors"), self.settings.term_synonyms))

    def expand(self, corpus: DataFrame, planned: DataFrame, held: lexicon.Lexicon) -> tuple[DataFrame, DataFrame]:
        """(evidence, attempts) of a second round for questions that name authors: the question, and each author with the question's terms, among that author's sources.

        Its hits arrive behind the others and, unless the settings say so, pass no filter.
        """
        s = self.settings
        more = F.when(F.size("terms") > 0, F.transform("authors", lambda a: F.concat_ws(" ", a, F.array_join("terms", " ")))).otherwise(F.array().cast("array<string>"))
        asked = self.asked(planned).where(F.size("authors") > 0)
        subs = asked.select(F.col("query_id").alias("_q"), "authors", F.col("terms").alias("required"), F.posexplode(F.concat(F.array("query"), more)).alias("sub_query_idx", "query"))
        subs = subs.withColumn("query_id", F.struct("_q", "sub_query_idx"))
        hits = keep(held.author_search(subs.select("query_id", "query", "authors", "required"), s.author_top_k).drop("source").join(corpus.select(*CHUNK), "id"), "author-hits")
        tried = self.attempts(subs, "lexical_author", hits)
        rows = hits.withColumns({"sub_query_idx": F.col("query_id.sub_query_idx") + SECOND, "query_id": F.col("query_id._q"), "agent": F.lit("lexical_author"), "agent_idx": F.lit(len(retrieve.AGENTS)), "domain_idx": F.lit(0)})
        return rows.withColumn("arrival", SECOND + F.col("sub_query_idx") * s.author_top_k + F.col("rank")), tried

    def retrieve(self, corpus: DataFrame, planned: DataFrame, held: lexicon.Lexicon | None = None) -> tuple[DataFrame, DataFrame]:
        """(evidence, attempts): hits of all agents for all sub-questions, ids once in order of arrival."""
        s = self.settings
        subs = planned.select(F.col("query_id").alias("_q"), "domain", *(c for c in ("tenant", "settings") if c in planned.columns), F.posexplode("queries").alias("sub_query_idx", "query"))
        subs = domains.fan_out(subs, s) if s.domain_collections else subs.withColumns({"domain_idx": F.lit(0), "index": F.lit(domains.BASE)})
        subs = subs.withColumn("query_id", F.struct("_q", "sub_query_idx", "domain_idx"))
        full = corpus.select(*CHUNK)
        held = held or self.index(corpus)
        hits = keep(self.search(held, subs).join(full, "id"), "hits")
        lines = retrieve.structured(hits, subs.select("query_id", "query"), s.top_k, s)
        lines = lines.withColumns({"offset_start": F.lit(None).cast("int"), "offset_end": F.lit(None).cast("int")}).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "line"))).drop("line")
        flat = lambda df: df.withColumns({"sub_query_idx": F.col("query_id.sub_query_idx"), "domain_idx": F.col("query_id.domain_idx"), "query_id": F.col("query_id._q")})
        agents = {"lexical": hits, "structured": lines}
        if self.embed:
            near = self.vector_hits(full, subs.where("domain_idx = 0"))  # vectors aren't kept by domain
            agents = {"vector": keep(near.join(full, "id"), "near")} | agents
        found = retrieve.fan_out({name: flat(rows) for name, rows in agents.items()})
        tried = {"lexical": subs, "vector": subs.where("domain_idx = 0")}
        attempts = reduce(DataFrame.union, (self.attempts(tried[name], name, agents[name]) for name in agents if name != "structured"))
        return keep(retrieve.arrival(found), "found"), attempts  # read by ranking and by the diagnostics

    def index(self, corpus: DataFrame) -> lexicon.Lexicon:
        """An index of the chunks; by domain if the settings search that way."""
        if self.settings.domain_collections:
            return domains.lexicon_of(store.namespaced(corpus).select("id", "text", "source", "index"), self.settings)
        return lexicon.index_of(corpus.select("id", "text", "source"), self.settings)

    def search(self, held: lexicon.Lexicon, subs: DataFrame) -> DataFrame:
        """Lexical hits of subs(query_id, query, index). Where questions carry settings, equal sub-questions are searched once for all, for the most hits, of which each keeps its own number."""
        if "settings" not in subs.columns:
            return held.search(subs.select("query_id", "query", "index"), self.settings.top_k)
        asked = keep(subs.select("query_id", "query", "index", F.sha2(F.concat_ws("\n", "index", "query"), 256).alias("_asked"), F.col("settings.top_k").alias("_k")), "sub-questions")
        most = asked.agg(F.max("_k")).first()[0] or 1
        hits = held.search(asked.groupBy(F.col("_asked").alias("query_id")).agg(F.first("query").alias("query"), F.first("index").alias("index")), most)
        return hits.withColumnRenamed("query_id", "_asked").join(asked.drop("query", "index"), "_asked").where(F.col("rank") <= F.col("_k")).drop("_asked", "_k")

    def vector_hits(self, full: DataFrame, subs: DataFrame) -> DataFrame:
        """Nearest chunks of each sub-question by the vectors that embed makes; all lists that may hold one are read."""
        held = vectors.VectorIndex(full.sparkSession, place(full.sparkSession, "vectors"), self.settings)
        held.add(full.select("id", "source", self.embed(F.col("text")).alias("embedding")))
        return held.search(subs.select("query_id", self.embed(F.col("query")).alias("embedding")), exact=True)

    def attempts(self, subs: DataFrame, agent: str, hits: DataFrame) -> DataFrame:
        """(query_id, agent, status) of each sub-question."""
        got = hits.select("query_id").distinct().withColumn("_hit", F.lit(True))
        return subs.join(got, "query_id", "left").select(F.col("_q").alias("query_id"), F.lit(agent).alias("agent"), F.when(F.col("_hit"), "ok").otherwise("zero_hits").alias("status"))

    def rank(self, planned: DataFrame, hits: DataFrame, late: DataFrame | None = None) -> DataFrame:
        """Evidence of each question after policy, freshness, duplicates and reranking, with places. late: hits of a second round."""
        s = self.settings if "settings" not in planned.columns else sweep.Row(self.settings)
        there = lambda df: df.where(T.falsy(F.col("text"), "").isNotNull())
        if "policy" in planned.columns:
            allowed = lambda df: policy.apply_by_question(df, planned, self.now)
        else:
            allowed = lambda df: policy.apply_policy(df, s).where(policy.fresh(F.col("timestamp"), F.lit(s.freshness_days).cast("double"), self.now))
        rows = allowed(there(hits))
        if late is not None:
            rows = rows.unionByName(allowed(there(late)) if s.filter_author_hits else there(late), allowMissingColumns=True)
        rows = rows.withColumn("n_normal", F.count("*").over(Window.partitionBy("query_id")))
        rows = evidence.dedupe_text(rows, ("query_id",))
        asked = self.asked(planned)
        if "settings" in planned.columns:
            asked = asked.join(planned.select("query_id", "settings"), "query_id")
        rows = rows.join(asked, "query_id")
        rows = rows.withColumn("rerank_score", models.lexical_rerank(F.col("query"), F.col("text")))
        rows = evidence.rerank(rows, s)
        rows = evidence.bias_sort(rows.withColumn("author_bias", evidence.author_bias(F.col("authors"), F.col("source"), F.col("text"), s)))
        low = F.lower("text")
        rows = rows.withColumns({
            "is_author": evidence.matches_author(F.col("authors"), F.col("source"), F.col("text")),
            "has_term": F.exists("terms", lambda t: F.contains(low, t)),
            "has_terms": F.size("terms") > 0,
        })
        return evidence.prefer_author(rows)

    def answer(self, corpus: DataFrame, questions: DataFrame, graph: Graph | None = None) -> DataFrame:
        """One row for each question: answer, provenance, confidence, domain, failure tags, risk and coverage.

        With a graph, what it says to each question's evidence raises or lowers the confidence.
        """
        planned = self.plan(questions)
        s = self.settings if "settings" not in planned.columns else sweep.Row(self.settings)
        held = self.index(corpus)
        hits, attempts = self.retrieve(corpus, planned, held)
        late = None
        if any(p.get("authors") for p in self.packs):
            by_author = lexicon.index_of(corpus.select("id", "text", "source"), self.settings) if s.domain_collections else held
            late, more = self.expand(corpus, planned, by_author)
            attempts, late = attempts.union(more), keep(late, "late")
        ranked = keep(self.rank(planned, hits, late), "ranked")
        one = F.struct("place", "id", "text", "source", "offset_start", "offset_end", "rerank_score", "is_author")
        best = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(one)).alias("rows"), F.max("author_gap").alias("author_gap"), F.first("authors").alias("authors"), F.countDistinct("domain").alias("n_domains"), F.max("n_normal").alias("n_normal"))
        raw = (hits if late is None else hits.select("query_id").union(late.select("query_id"))).groupBy("query_id").agg(F.count("*").alias("n_raw"))
        tried = retrieve.diagnostics(attempts).select("query_id", "agent", F.struct("attempted", "ok", "zero_hits", "timeout", "error").alias("_d"))
        asked = ["lexical", *(["vector"] if self.embed else []), *(["lexical_author"] if late is not None else [])]
        tried = tried.groupBy("query_id").agg(*(F.any_value(F.when(F.col("agent") == a, F.col("_d")), True).alias(a) for a in asked))
        q = planned.join(best, "query_id", "left").join(raw, "query_id", "left").join(tried, "query_id", "left")
        q = q.withColumns({"rows": F.coalesce("rows", F.array()), "author_gap": F.coalesce("author_gap", F.lit(False)), "authors": F.coalesce("authors", F.array().cast("array<string>")), "n_raw": F.coalesce("n_raw", F.lit(0)), "n_domains": F.coalesce("n_domains", F.lit(0)), "n_normal": F.coalesce("n_normal", F.lit(0))})
        none, no_note = F.lit(0), F.lit(None).cast("string")
        snippets = F.transform(F.slice("rows", 1, self.settings.max_evidence), lambda r: F.struct(r["id"].alias("id"), r["source"].alias("source"), F.substring(r["text"], 1, 400).alias("text")))
        base, note, trusted = F.lit(s.judge_non_json), no_note, F.array().cast("array<string>")
        if self.judge:
            q = q.withColumn("_said", self.judge(F.col("query"), snippets))
            q = q.withColumn("_judged", judge.judge_ladder(F.col("_said"), F.col("_said").isNull(), F.transform("rows", lambda r: r["id"]), s))
            base, trusted = F.coalesce("_judged.confidence", F.lit(s.judge_error)), F.coalesce("_judged.trusted_ids", trusted)
            note = F.when(F.col("_judged.branch") == "json", F.get_json_object(T.json_body(F.col("_said")), "$.notes")).otherwise(F.concat(F.lit("judge_"), "_judged.branch"))
        q = q.withColumn("_base", base.cast("double")).withColumn("_note", note)
        picks = F.flatten(F.transform(trusted, lambda t: F.slice(F.filter("rows", lambda r: r["id"] == t), 1, 1)))
        q = q.withColumn("_top", F.when(F.size(picks) > 0, picks).otherwise(F.slice("rows", 1, 3)))
        # where an author has no passage with the question's words, others' passages go before, if there are any
        for c in ("_top", "rows"):
            others = F.filter(c, lambda r: ~F.coalesce(r["is_author"], F.lit(False)))
            q = q.withColumn(c, F.when(F.col("author_gap") & (F.size("authors") > 0) & (F.size(others) > 0), others).otherwise(F.col(c)))
        top = F.col("_top")
        good = F.filter(top, lambda r: r["offset_start"].isNotNull() & r["offset_end"].isNotNull() & (F.coalesce(r["source"], F.lit("")) != ""))
        q = q.withColumn("provenance", F.transform(good, lambda r: F.struct(r["id"].alias("id"), r["source"].alias("source"), r["offset_start"].alias("offset_start"), r["offset_end"].alias("offset_end"))))
        base, signs = F.col("_base"), (none, none, none)
        if graph is not None:
            parts = context.of_results(graph, ranked.where(F.col("place") <= s.rerank_top_k).select("query_id", "id", "text"), s)
            q = q.join(context.signals(parts), "query_id", "left")
            signs = tuple(F.coalesce(c, none) for c in ("contradictions", "conflicts", "strong"))
            base = judge.confidence(base, *signs, s)
        q = q.withColumn("_judge", base).withColumn("notes", judge.notes(F.col("_note"), *signs))
        texts = F.transform(top, lambda r: r["text"])
        if self.write:
            picked = F.transform(top, lambda r: F.struct(r["id"].alias("id"), r["source"].alias("source"), r["text"].alias("text")))
            q = q.withColumn("_w", self.write(F.col("query"), picked))
            made = judge.synthesis_ladder(F.col("_w.response"), F.col("_w.naturalized"), F.col("_w.status"), texts, F.col("authors"), F.col("author_gap"), F.col("_judge"), s)
            q = q.withColumn("_made", made).withColumns({"answer": F.col("_made.answer"), "confidence": F.col("_made.confidence"), "explain_trace": F.col("_made.explain_trace")})
        else:
            q = q.withColumns({"answer": T.fallback_answer(texts, F.col("authors"), F.col("author_gap")), "confidence": F.col("_judge"), "explain_trace": F.lit("")})
        first = F.get("rows", F.lit(0))
        tags = judge.failure_tags({"domain": F.col("domain"), "n_raw": F.col("n_raw"), "n_normal": F.col("n_normal"), **{a: F.col(a) for a in asked}, "n_domains": F.col("n_domains"), "n_rows": F.size("rows"), "author_gap": F.col("author_gap"), "explain_trace": F.col("explain_trace"), "top_score": first["rerank_score"]}, s)
        q = q.withColumn("retrieval_failures", tags)
        lifted = judge.floored(F.col("confidence"), F.size("rows"), F.size("authors") > 0, F.col("author_gap"), F.coalesce(first["is_author"], F.lit(False)), first["rerank_score"], F.col("retrieval_failures"), s)
        return q.select(
            "query_id", "query", "intent", "domain", "domain_source", "answer", "provenance", "confidence", "author_gap", "retrieval_failures",
            judge.hallucination_risk(lifted, F.size("provenance"), F.col("retrieval_failures"), F.col("author_gap")).alias("hallucination_risk"),
            judge.evidence_coverage(F.size("provenance"), F.size("rows"), s).alias("evidence_coverage"), F.size("rows").alias("n_rows"),
            F.transform("rows", lambda r: F.struct(r["id"].alias("id"), r["source"].alias("source"), r["text"].alias("text"))).alias("results"), "explain_trace", "notes",
        )

    def cache_key(self, questions: DataFrame) -> Column:
        """What an answer depends on: the question, the wishes that come with it, the tenant and the settings' policy."""
        text = lambda c: F.coalesce(F.to_json(F.col(c)), F.lit("")) if c in questions.columns else F.lit("")
        wishes = F.create_map(*(x for c in policy.SAID for x in (F.lit(c), text(c))))
        tenant = F.col("tenant") if "tenant" in questions.columns else F.lit(None).cast("string")
        return T.cache_key(F.col("query"), wishes, tenant, policy.policy_signature(self.settings))

    def answer_cached(self, corpus: DataFrame, questions: DataFrame, cache: AnswerCache, now: float, txn: tuple[str, int] | None = None) -> DataFrame:
        """answer, with ``cache``: hit for questions whose answer was remembered and hasn't expired, else miss.

        Of questions that are equal but for blanks and case only the one with the least id is
        answered; all of them get its answer under their own id and words. New answers are
        remembered, under txn once.
        """
        asked = keep(questions.withColumn("key", self.cache_key(questions)), "asked")
        held = keep(cache.get(asked, now), "held")
        first = asked.join(held, "key", "left_anti").groupBy("key").agg(F.min_by(F.struct(*questions.columns), "query_id").alias("_q"))
        first = keep(first.select("key", "_q.*"), "first")
        names = [f.name for f in StructType.fromDDL(self.kind).fields]
        if not first.isEmpty():
            made = self.answer(corpus, first.drop("key")).join(first.select("query_id", "key"), "query_id")
            made = keep(made.select("key", F.to_json(F.struct(*names)).alias("value")), "made")
            cache.put(made, now, txn)
            held = held.withColumn("cache", F.lit("hit")).union(made.withColumn("cache", F.lit("miss")))
        else:
            held = held.withColumn("cache", F.lit("hit"))
        rows = asked.select("key", F.col("query_id").alias("_id"), F.col("query").alias("_query")).join(held, "key")
        return rows.withColumn("_a", F.from_json("value", self.kind)).select(F.col("_id").alias("query_id"), F.col("_query").alias("query"), *(F.col("_a")[c].alias(c) for c in names), "cache")

    def ablate(self, corpus: DataFrame, questions: DataFrame, configs: dict[str, Settings], graph: Graph | None = None) -> DataFrame:
        """Rows of all questions under all configurations (``sweep.runs``), from one index and one search of the corpus.

        The engine's own settings must be those that the configurations share. A question that is
        null or blank is an error's row in each.
        """
        wanted = sweep.spread(questions, {"": self.settings} | configs).where(F.col("query_id.config") != "")
        blank = T.strip(F.coalesce("query", F.lit(""))) == ""
        errors = wanted.where(blank).select("query_id", "query", F.lit("empty question").alias("error"))
        return sweep.runs(self.answer(corpus, wanted.where(~blank), graph), errors)
