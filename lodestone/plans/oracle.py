"""DuckDB's SQL for the rows of the queries in ``queries``."""

from __future__ import annotations

START = 1704067200
NOW = START + 500 * 3600

#: Shared parts.
CORPUS = f"c AS (SELECT doc_id AS id, text, source, 'txt' AS source_type, lang AS domain, {START}.0::DOUBLE + doc_id * 3600.0 AS timestamp FROM documents)"
WORDS = r"list_filter(string_split_regex(coalesce({}, ''), '\s+'), lambda w: w <> '')"
ASKED = f"q AS (SELECT item_id AS query_id, array_to_string({WORDS.format('text')}, ' ') AS query FROM benchmark)"
TOKENS = r"regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}0-9]+')"
POSTINGS = f"""w AS (SELECT id, {TOKENS.format('text')} AS ws FROM c),
size AS (SELECT count(*)::DOUBLE AS n, avg(len(ws)) AS avgdl FROM w),
tf AS (SELECT id, term, count(*) AS tf, max(dl) AS dl FROM (SELECT id, len(ws) AS dl, unnest(ws) AS term FROM w) GROUP BY id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
weighted AS (SELECT id, term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS w FROM tf JOIN df USING (term), size)"""


def bm25(asked: str, name: str) -> str:
    """CTEs of the scores of a table of questions."""
    return f"""{name}_t AS (SELECT DISTINCT query_id, unnest({TOKENS.format('query')}) AS term FROM {asked}),
{name} AS (SELECT query_id, id, round(sum(w), 9) AS score FROM {name}_t JOIN weighted USING (term) GROUP BY query_id, id)"""


def ranked(scores: str, k: int) -> str:
    return f"SELECT query_id, id, rank, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM {scores}) WHERE rank <= {k}"


GRAPH = """l AS (SELECT l_orderkey AS chunk_id, concat_ws(':', l_orderkey, l_linenumber) AS claim_id, 's' || l_suppkey AS s, 'p' || l_partkey AS p, l_returnflag AS f FROM lineitem),
ce AS (SELECT DISTINCT chunk_id, name FROM (SELECT chunk_id, s AS name FROM l UNION ALL SELECT chunk_id, p FROM l)),
ke AS (SELECT DISTINCT claim_id, name FROM (SELECT claim_id, s AS name FROM l UNION ALL SELECT claim_id, p FROM l)),
rel AS (SELECT DISTINCT s AS src, f AS predicate, p AS dst FROM l),
con AS (SELECT DISTINCT claim_id AS a, concat_ws(':', chunk_id, 1) AS b FROM l WHERE f = 'R' AND claim_id <> concat_ws(':', chunk_id, 1)),
both_ AS (SELECT a AS claim_id, b AS other FROM con UNION ALL SELECT b, a FROM con)"""

JUDGED = """j AS (SELECT l_orderkey AS query_id, count(*) FILTER (l_returnflag = 'R') AS contradictions, count(*) FILTER (l_linestatus = 'F') AS conflicts,
  count(*) AS strong, sum(l_linenumber) AS w, (l_orderkey % 10) / 10.0::DOUBLE AS base FROM lineitem GROUP BY l_orderkey)"""


def agent_tag(agent: str, k: int) -> str:
    return f"CASE WHEN query_id % {k} = 0 THEN CASE WHEN query_id % 4 = 0 THEN '{agent}_timeout' WHEN query_id % 6 = 0 THEN '{agent}_error' ELSE '{agent}_zero_hits' END END"


TAGGED = f"""{JUDGED}, t AS (SELECT *, query_id % 7 = 0 AS gap, list_filter([
  CASE WHEN query_id % 5 = 0 THEN 'no_domain' END,
  CASE WHEN strong > 0 AND conflicts = 0 THEN 'policy_blocked' END,
  {agent_tag('vector', 2)}, {agent_tag('lexical', 3)}, {agent_tag('structured', 5)},
  CASE WHEN query_id % 5 <> 0 AND contradictions > 1 THEN 'cross_domain_conflict' END,
  CASE WHEN conflicts = 0 THEN 'no_results' END,
  CASE WHEN query_id % 7 = 0 THEN 'author_gap' END,
  CASE WHEN query_id % 11 = 0 THEN 'synthesis_timeout' WHEN query_id % 13 = 0 THEN 'synthesis_error' END,
  CASE WHEN conflicts < 3 THEN 'low_result_count' END,
  CASE WHEN conflicts > 0 AND -5 - w < -12 THEN 'low_top_score' END], lambda x: x IS NOT NULL) AS tags FROM j)"""

AUDIT = "a AS (SELECT event_id AS id, CAST(user_id AS VARCHAR) AS user_id, json_extract_string(props, '$.k') AS query, event_type, CAST(floor(epoch(ts)) AS DOUBLE) AS created_at, CAST(event_id % 5 + 1 AS INTEGER) AS rating FROM events)"


def buckets(value: str, bounds: tuple, source: str = "events") -> str:
    named = ", ".join(f"('{b:g}', {b}::DOUBLE)" for b in bounds)
    return f"""SELECT event_type, le, count(*) AS n FROM {source}, (VALUES {named}, ('+Inf', 'inf'::DOUBLE)) b(le, bound)
WHERE {value} <= bound GROUP BY event_type, le"""


REQUEST_MS = (50, 100, 250, 500, 1000, 2000, 5000)

SQL = {
    "chunk_words": f"""WITH w AS (SELECT doc_id, {WORDS.format('text')} AS ws FROM documents)
SELECT doc_id, CAST(i / 150 AS INTEGER) AS chunk_index, array_to_string(ws[i + 1:i + 200], ' ') AS text FROM (SELECT doc_id, ws, unnest(range(0, len(ws), 150)) AS i FROM w)""",
    "chunk_namespace": """SELECT doc_id AS id, 'docs_' || CASE WHEN lang <> 'en' THEN lang ELSE source END AS collection, 'docs_index_' || CASE WHEN lang <> 'en' THEN lang ELSE source END AS index FROM documents""",
    "lexical_topk": f"""WITH {CORPUS}, {ASKED}, {POSTINGS}, {bm25('q', 's')}, r AS ({ranked('s', 6)}) SELECT query_id, id, rank, round(score, 6) AS score FROM r""",
    "domain_topk": f"""WITH w AS (SELECT doc_id AS id, coalesce(nullif(lang, 'de'), 'base') AS i, {TOKENS.format('text')} AS ws FROM documents),
size AS (SELECT i, count(*)::DOUBLE AS n, avg(len(ws)) AS avgdl FROM w GROUP BY i),
tf AS (SELECT i, id, term, count(*) AS tf, max(dl) AS dl FROM (SELECT i, id, len(ws) AS dl, unnest(ws) AS term FROM w) GROUP BY i, id, term),
df AS (SELECT i, term, count(*) AS df FROM tf GROUP BY i, term),
weighted AS (SELECT i, id, term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS w FROM tf JOIN df USING (i, term) JOIN size USING (i)),
{ASKED}, a AS (SELECT query_id, query, unnest(CASE query_id % 5 WHEN 0 THEN ['en', 'es'] WHEN 1 THEN ['fr', 'es', 'en'] WHEN 2 THEN ['base', 'es', 'en'] ELSE ['es', 'en'] END) AS i,
  generate_subscripts(CASE query_id % 5 WHEN 0 THEN ['en', 'es'] WHEN 1 THEN ['fr', 'es', 'en'] WHEN 2 THEN ['base', 'es', 'en'] ELSE ['es', 'en'] END, 1) - 1 AS domain_idx FROM q),
t AS (SELECT DISTINCT query_id, domain_idx, i, unnest({TOKENS.format('query')}) AS term FROM a),
s AS (SELECT query_id, domain_idx, id, round(sum(w), 9) AS score FROM t JOIN weighted USING (i, term) GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, domain_idx ORDER BY score DESC, id) AS INTEGER) AS rank FROM s),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY domain_idx, rank) AS first FROM r WHERE rank <= 6)
SELECT query_id, id, CAST(domain_idx AS INTEGER) AS domain_idx, rank, round(score, 6) AS score FROM f WHERE first = 1""",
    "vector_topk": """WITH s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM s) SELECT query_id, id, rank, round(score, 6) AS score FROM r WHERE rank <= 6""",
    "author_lexical_topk": f"""WITH {CORPUS}, {ASKED}, {POSTINGS},
x AS (SELECT query_id, query, 'src' || (query_id % 20) AS author, CASE WHEN query_id % 2 = 0 THEN string_split(query, ' ')[-1] ELSE 'nosuchword' END AS required FROM q),
req AS (SELECT query_id, required AS query FROM x), {bm25('q', 'base')}, {bm25('req', 'extra')},
b AS (SELECT query_id, id, base.score AS s, extra.score AS r FROM base FULL JOIN extra USING (query_id, id) JOIN c USING (id) JOIN x USING (query_id) WHERE contains(c.source, x.author)),
strict AS (SELECT query_id, id, round(coalesce(s, 0) + r, 9) AS score FROM b WHERE r IS NOT NULL),
found AS (SELECT * FROM strict UNION ALL SELECT query_id, id, s FROM b WHERE s IS NOT NULL AND query_id NOT IN (SELECT query_id FROM strict)),
r AS ({ranked('found', 24)}) SELECT query_id, id, rank, round(score, 6) AS score FROM r""",
    "structured_lines": """WITH o AS (SELECT o_orderkey AS id, concat_ws(' | ', 'order: ' || o_orderkey, 'status: ' || o_orderstatus, 'priority: ' || o_orderpriority) AS x, 'customer: ' || o_custkey AS y FROM orders)
SELECT id, CAST(line AS INTEGER) AS line, text FROM (SELECT id, 0 AS line, x AS text FROM o UNION ALL SELECT id, 1, x FROM o UNION ALL SELECT id, 2, y FROM o)""",
    "text_dedupe": f"""WITH n AS (SELECT doc_id AS id, source, array_to_string({WORDS.format('lower(text)')}, ' ') AS f FROM documents)
SELECT id, source FROM (SELECT *, row_number() OVER (PARTITION BY f ORDER BY id) AS r FROM n) WHERE r = 1""",
    "policy_filter": """SELECT doc_id AS id, lang AS domain FROM documents WHERE NOT contains(lower(text), 'worthless') AND NOT contains(lower(text), 'idiot') AND lang <> 'fr'""",
    "policy_rules": """SELECT doc_id AS id, lang AS domain FROM documents WHERE CASE WHEN lang = 'en' AND contains(lower(text), 'the') THEN true
WHEN lang IN ('en', 'fr') AND NOT contains(lower(text), 'worthless') THEN false WHEN contains(lower(text), 'copyright') THEN false ELSE true END""",
    "policy_by_question": f"""WITH {CORPUS}, {ASKED}, {POSTINGS}, {bm25('q', 's')}, r AS ({ranked('s', 24)}),
h AS (SELECT r.*, lower(c.text) AS t, c.domain, c.timestamp, query_id AS n FROM r JOIN c USING (id))
SELECT query_id, id, rank FROM h WHERE NOT (n % 3 = 0 AND (contains(t, 'worthless') OR contains(t, 'idiot'))) AND NOT (n % 4 = 1 AND domain NOT IN ('en', 'fr'))
AND domain <> 'pt' AND NOT (n % 4 = 2 AND domain = 'de') AND NOT (n % 6 = 1 AND NOT contains(t, 'e')) AND NOT (n % 8 = 0 AND domain = 'en' AND contains(t, 'the'))
AND timestamp >= CASE WHEN n % 7 = 0 THEN {NOW} - 10 * 86400.0 WHEN n % 10 = 5 THEN {NOW} - 5 * 86400.0 WHEN n % 10 = 0 THEN {NOW} - 15 * 86400.0 ELSE 0 END""",
    "config_axis": f"""WITH {CORPUS}, {ASKED}, {POSTINGS}, {bm25('q', 's')}, r AS ({ranked('s', 20)}), h AS (SELECT r.*, lower(c.text) AS t, c.domain, c.timestamp FROM r JOIN c USING (id))
SELECT 'plain' AS config, query_id, id, rank FROM h WHERE rank <= 6 UNION ALL SELECT 'few', query_id, id, rank FROM h WHERE rank <= 2 AND NOT contains(t, 'worthless')
UNION ALL SELECT 'many', query_id, id, rank FROM h WHERE domain IN ('en', 'fr') AND timestamp >= {NOW} - 15 * 86400.0""",
    "freshness": f"""WITH {CORPUS} SELECT id, timestamp FROM c WHERE timestamp >= {NOW}.0 - 5 * 86400.0""",
    "route_domain": """WITH k AS (SELECT conv_id, turn, lower(text) AS t, CASE WHEN role = 'system' THEN 'en' END AS c, CASE WHEN turn % 5 = 4 THEN 'fr' END AS p FROM conversations),
s AS (SELECT *, contains(t, 'und')::INT + contains(t, 'nicht')::INT + 2 * contains(t, 'de')::INT AS de, contains(t, 'the')::INT + contains(t, 'and')::INT + contains(t, 'with')::INT + 2 * contains(t, 'en')::INT AS en,
 contains(t, 'que')::INT + contains(t, 'para')::INT + 2 * contains(t, 'ción')::INT + 2 * contains(t, 'es')::INT AS es, contains(t, 'les')::INT + contains(t, 'pour')::INT + 2 * contains(t, 'fr')::INT AS fr FROM k),
m AS (SELECT *, greatest(de, en, es, fr) AS top FROM s),
d AS (SELECT conv_id, turn, c, p, coalesce(c, p, CASE WHEN top < 2 THEN NULL WHEN de = top THEN 'de' WHEN en = top THEN 'en' WHEN es = top THEN 'es' ELSE 'fr' END) AS domain FROM m)
SELECT conv_id, turn, domain, CASE WHEN c IS NOT NULL THEN 'constraint' WHEN p IS NOT NULL THEN 'preference' WHEN domain IS NOT NULL THEN 'keyword' ELSE 'unknown' END AS domain_source FROM d""",
    "author_bias_rank": """WITH b AS (SELECT lang AS query_id, doc_id AS id, (doc_id % 10) / 10.0::DOUBLE AS score, CASE WHEN contains(lower(source), 'src1') OR contains(lower(source), 'idiot') THEN 0.8::DOUBLE WHEN contains(lower(text), 'src1') OR contains(lower(text), 'idiot') THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END AS author_bias FROM documents)
SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score + author_bias DESC, id) AS INTEGER) AS place, author_bias FROM b""",
    "plan_rules": """WITH k AS (SELECT conv_id, turn, text, contains(lower(text), 'the') OR contains(lower(text), 'and') AS e, contains(lower(text), 'que') AS s FROM conversations),
p AS (SELECT *, CASE WHEN e OR s THEN array_to_string(list_filter([CASE WHEN e THEN 'the question' END, CASE WHEN s THEN 'la pregunta' END], lambda x: x IS NOT NULL), '; ') ELSE text END AS qs FROM k)
SELECT conv_id, turn, CASE WHEN s THEN 'spanish' WHEN e THEN 'english' ELSE 'general' END AS intent, concat_ws('; ', CASE WHEN e THEN 'asks in English' END, CASE WHEN s THEN 'asks in Spanish' END) AS hypotheses,
 CAST(greatest(1, e::INT + s::INT) AS INTEGER) AS n_queries, md5(qs) AS queries_md5 FROM p""",
    "query_terms": f"""WITH {ASKED}, t AS (SELECT query_id, list_filter(regexp_extract_all(lower(query), '[a-z][a-z\\-]+'), lambda w: length(w) >= 3 AND w <> 'thing' AND NOT list_contains(['a', 'an', 'the', 'and', 'or', 'of', 'to', 'in', 'on', 'for', 'with', 'what', 'why', 'how', 'who', 'where', 'when', 'which', 'whom', 'whose'], w)) AS ws FROM q),
e AS (SELECT query_id, flatten(list_transform(ws, lambda w: CASE WHEN w = 'thor' THEN [w, 'hammer', 'thunder'] ELSE [w] END)) AS es FROM t)
SELECT query_id, array_to_string(list_filter(es, lambda w, i: list_position(es, w) = i), ' ') AS terms FROM e""",
    "claims_split": r"""WITH p AS (SELECT doc_id AS id, list_filter(list_transform(string_split(replace(text, chr(10), ' '), '.'), lambda x: trim(x)), lambda x: x <> '')[1:5] AS cs FROM documents)
SELECT id, CAST(i - 1 AS INTEGER) AS i, cs[i] AS claim FROM (SELECT id, cs, unnest(range(1, len(cs) + 1)) AS i FROM p)""",
    "negation": r"""SELECT doc_id AS id, list_bool_or(list_transform([' not ', ' no ', ' never ', ' cannot ', ' can''t ', ' won''t ', ' isn''t ', ' aren''t ', ' wasn''t ', ' weren''t '], lambda n: contains(' ' || lower(text) || ' ', n))) AS negated,
CAST(len(list_filter(regexp_extract_all(text, '[0-9.]+'), lambda x: try_cast(x AS DOUBLE) IS NOT NULL)) AS INTEGER) AS n_numbers FROM documents""",
    "claim_paraphrases": rf"""WITH p AS (SELECT printf('%08d', doc_id) AS chunk_id, list_filter(list_transform(string_split(replace(text, chr(10), ' '), '.'), lambda x: trim(x)), lambda x: x <> '')[1:5] AS cs FROM documents),
k AS (SELECT chunk_id || '::claim::' || (i - 1) AS id, cs[i] AS text FROM (SELECT chunk_id, cs, unnest(range(1, len(cs) + 1)) AS i FROM p)),
t AS (SELECT id, list_distinct(list_filter(string_split_regex(regexp_replace(lower(text), '[,;:]', ' ', 'g'), '\s+'), lambda w: regexp_full_match(w, '\p{{L}}{{3,}}'))) AS ts FROM k),
e AS (SELECT id, unnest(ts) AS token FROM t),
m AS (SELECT x.id AS a, y.id AS b, count(*) AS shared FROM e x JOIN e y ON x.token = y.token AND x.id > y.id GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT a, b, CAST(shared AS INTEGER) AS shared FROM m JOIN t x ON x.id = a JOIN t y ON y.id = b WHERE shared >= greatest(3, floor(0.6::DOUBLE * least(len(x.ts), len(y.ts))))""",
    "graph_density": f"WITH {GRAPH} SELECT name, count(DISTINCT chunk_id) AS chunks FROM ce GROUP BY name",
    "graph_claims": f"""WITH {GRAPH}, s AS (SELECT claim_id, count(DISTINCT chunk_id) AS support_count FROM l GROUP BY claim_id), x AS (SELECT claim_id, count(DISTINCT other) AS n FROM both_ GROUP BY claim_id)
SELECT claim_id, support_count, coalesce(n, 0) AS contradict_count FROM s LEFT JOIN x USING (claim_id)""",
    "graph_evidence": f"""WITH {GRAPH}, s AS (SELECT chunk_id, count(DISTINCT claim_id) AS support FROM l GROUP BY chunk_id), e AS (SELECT chunk_id, count(DISTINCT name) AS entities FROM ce GROUP BY chunk_id),
x AS (SELECT chunk_id, count(DISTINCT other) AS contradictions FROM l JOIN both_ USING (claim_id) GROUP BY chunk_id)
SELECT chunk_id, support, entities, coalesce(contradictions, 0) AS contradictions, round(support + 0.1::DOUBLE * entities - 0.5::DOUBLE * coalesce(contradictions, 0), 3) AS score FROM s JOIN e USING (chunk_id) LEFT JOIN x USING (chunk_id)""",
    "graph_relations": f"""WITH {GRAPH} SELECT src, predicate, dst, CAST(count(*) AS BIGINT) AS strength FROM ce JOIN rel ON ce.name = rel.src GROUP BY src, predicate, dst HAVING count(*) >= 2""",
    "graph_conflicts": f"""WITH {GRAPH} SELECT src, dst, array_to_string(list_sort(list(DISTINCT predicate)), ',') AS predicates FROM rel GROUP BY src, dst HAVING count(DISTINCT predicate) > 1""",
    "graph_paths": f"""WITH {GRAPH} SELECT l.chunk_id, ke.name AS src, dst, count(*) AS n FROM l JOIN ke USING (claim_id) JOIN rel ON ke.name = rel.src GROUP BY ALL ORDER BY n DESC, l.chunk_id, src, dst LIMIT 10""",
    "graph_path_totals": f"""WITH {GRAPH}, p AS (SELECT l.chunk_id, ke.name AS src, dst, count(*) AS n FROM l JOIN ke USING (claim_id) JOIN rel ON ke.name = rel.src GROUP BY ALL)
SELECT chunk_id, count(*) AS pairs, CAST(sum(n) AS BIGINT) AS paths, max(n) AS most FROM p GROUP BY chunk_id""",
    "judge_confidence": f"""WITH {JUDGED}, a AS (SELECT *, CASE WHEN contradictions > 0 THEN least(base * (1 - least(0.5::DOUBLE, 0.1::DOUBLE * contradictions)), 0.6::DOUBLE) ELSE base END AS c1 FROM j),
b AS (SELECT *, CASE WHEN conflicts > 0 THEN greatest(0, c1 * (1 - least(0.5::DOUBLE, 0.15::DOUBLE * conflicts))) ELSE c1 END AS c2 FROM a)
SELECT query_id, round(CASE WHEN contradictions = 0 AND strong > 0 THEN least(1, c2 + least(0.2::DOUBLE, 0.05::DOUBLE * strong)) ELSE c2 END, 6) AS confidence FROM b""",
    "failure_tags": f"WITH {TAGGED} SELECT query_id, array_to_string(tags, ',') AS tags FROM t",
    "failure_counts": f"WITH {TAGGED} SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM t) GROUP BY tag",
    "risk_coverage": f"""WITH {TAGGED}, f AS (SELECT *, CASE WHEN conflicts > 0 AND query_id % 2 = 0 AND NOT gap AND strong > 2 AND -5 - w / 10.0::DOUBLE >= -6
 AND NOT list_has_any(tags, ['no_results', 'vector_timeout', 'vector_error', 'lexical_timeout', 'lexical_error', 'structured_timeout', 'structured_error', 'synthesis_timeout', 'synthesis_error']) THEN greatest(base, 0.55::DOUBLE) ELSE base END AS c FROM t)
SELECT query_id, round(greatest(0, least(1, 1 - c + CASE WHEN conflicts = 0 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN list_contains(tags, 'low_top_score') THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN gap THEN 0.1::DOUBLE ELSE 0 END)), 6) AS risk,
 round(least(1, conflicts::DOUBLE / greatest(1, least(8, strong))), 6) AS coverage FROM f""",
    "metrics_histogram": buckets("value", REQUEST_MS),
    "risk_histogram": "WITH r AS (SELECT event_type, greatest(0, least(1, value / 100.0::DOUBLE)) AS risk FROM events) " + buckets("risk", (0.2, 0.4, 0.6, 0.8, 1.0), "r"),
    "metrics_counters": "SELECT event_type, count(*) AS n, CAST(sum(CAST(trunc(greatest(0, value)) AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY event_type",
    "rate_limit": "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id, floor(epoch(ts) / 3600) ORDER BY ts, event_id) <= 1 AS allowed FROM events",
    "rate_counts": "SELECT user_id, CAST(floor(epoch(ts) / 60) AS BIGINT) AS minute, count(*) AS n FROM events GROUP BY 1, 2",
    "latency_p95": f"""WITH h AS ({buckets('value', REQUEST_MS)}), o AS (SELECT event_type, CASE WHEN le = '+Inf' THEN 'inf'::DOUBLE ELSE le::DOUBLE END AS le, n FROM h),
p AS (SELECT *, max(n) OVER (PARTITION BY event_type) AS total, coalesce(lag(le) OVER w, 0) AS low, coalesce(lag(n) OVER w, 0) AS below FROM o WINDOW w AS (PARTITION BY event_type ORDER BY le)),
r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY le) AS k FROM p WHERE n >= 0.95::DOUBLE * total)
SELECT event_type, round(CASE WHEN isinf(le) THEN low ELSE low + (le - low) * (0.95::DOUBLE * total - below) / (n - below) END, 6) AS p95 FROM r WHERE k = 1""",
    "hourly_rates": "SELECT event_type, CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS window_start, count(*) AS n FROM events GROUP BY 1, 2",
    "audit_page": f"""WITH {AUDIT} SELECT id, user_id, created_at FROM a WHERE event_type = 'view' AND (created_at < {START + 15 * 86400}.0 OR (created_at = {START + 15 * 86400}.0 AND id < 50)) ORDER BY created_at DESC, id DESC LIMIT 100""",
    "feedback_list": f"""WITH {AUDIT} SELECT id, rating, created_at FROM a WHERE event_type = 'purchase' AND rating >= 4 ORDER BY created_at DESC, id DESC LIMIT 200""",
    "training_export": f"""WITH {AUDIT}, f AS (SELECT user_id, query, rating, 'c' AS comment FROM (SELECT *, row_number() OVER (PARTITION BY user_id, query ORDER BY created_at, id) AS r FROM a WHERE event_type = 'purchase' AND rating >= 4) WHERE r = 1)
SELECT a.id, a.user_id, a.query, f.rating, f.comment FROM a LEFT JOIN f ON a.user_id = f.user_id AND a.query = f.query WHERE event_type = 'view'""",
    "delete_source": "SELECT doc_id AS id, source FROM documents WHERE source <> 'src3'",
    "reingest_replace": """WITH n AS (SELECT *, lang AS collection FROM documents WHERE source IN ('src1', 'src2') AND doc_id % 2 = 0)
SELECT doc_id AS id, source, 1 AS version FROM documents d WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.collection = d.lang AND n.source = d.source) UNION ALL SELECT doc_id, source, 2 FROM n""",
    "question_cache_keys": rf"""SELECT item_id AS query_id, true AS same,
 sha256('{{"query":' || CAST(to_json(array_to_string({WORDS.format('lower(text)')}, ' ')) AS VARCHAR) || ',"prefs":"[{{\"key\":\"a\",\"value\":\"2\"}},{{\"key\":\"b\",\"value\":\"1\"}}]","tenant":"t","policy":""}}') AS key FROM benchmark""",
    "job_states": """SELECT event_id // 4 AS job_id, 'ingest' AS kind, ['queued', 'running', 'succeeded', 'failed'][CAST(max(event_id) % 4 + 1 AS INTEGER)] AS status,
 max(event_id) FILTER (event_id % 4 = 0) AS created_at, max(event_id) FILTER (event_id % 4 = 1) AS started_at, max(event_id) FILTER (event_id % 4 >= 2) AS finished_at FROM events GROUP BY event_id // 4""",
}
for _name, _rank in (("fanout_union_dedupe", "query_id, id::VARCHAR AS id, agent, rank"), ("agent_counts", "query_id, agent, count(*) AS n")):
    SQL[_name] = f"""WITH {CORPUS}, {ASKED}, {POSTINGS}, t3 AS (SELECT query_id, list_filter(regexp_extract_all(lower(query), '[a-z][a-z\\-]+'), lambda w: length(w) >= 3 AND NOT list_contains(['a', 'an', 'the', 'and', 'or', 'of', 'to', 'in', 'on', 'for', 'with', 'what', 'why', 'how', 'who', 'where', 'when', 'which', 'whom', 'whose'], w)) AS ws FROM q),
q3 AS (SELECT query_id, array_to_string(list_filter(ws, lambda w, i: list_position(ws, w) = i), ' ') AS query FROM t3), {bm25('q', 's')}, {bm25('q3', 's3')},
u AS (SELECT *, 'lexical' AS agent, 0 AS sub FROM ({ranked('s', 6)}) UNION ALL SELECT *, 'again', 1 FROM ({ranked('s3', 6)})),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY sub, rank) AS k FROM u) WHERE k = 1)
SELECT {_rank} FROM f""" + (" GROUP BY query_id, agent" if _name == "agent_counts" else "")
SQL["author_gap"] = """WITH r AS (SELECT lang || '-' || (doc_id % 40) AS query_id, doc_id AS id, (doc_id % 7) / 7.0::DOUBLE AS score, CASE WHEN source IN ('src1', 'src2') THEN 0.8::DOUBLE ELSE 0 END AS bias,
 source IN ('src1', 'src2') AS au, contains(lower(text), 'worthless') AS te, doc_id % 40 % 3 <> 0 AS terms FROM documents),
h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score + bias DESC, id) AS p0, bool_or(au) OVER (PARTITION BY query_id) AS any_au, bool_or(au AND te) OVER (PARTITION BY query_id) AS good FROM r),
k AS (SELECT *, any_au AND terms AND NOT good AS author_gap FROM h WHERE NOT any_au OR CASE WHEN terms THEN (au AND te) OR NOT good ELSE au END)
SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score + bias - CASE WHEN author_gap THEN bias ELSE 0 END DESC, p0) AS INTEGER) AS place, author_gap FROM k"""


TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
SENTENCES = rf"list_filter(list_transform(string_split(regexp_replace({TRIM.format('{}')}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: {TRIM.format('x')}), lambda x: length(x) >= 20 AND regexp_matches(x, '^[A-Z]'))"
CLEAN = (
    rf"array_to_string(list_filter(string_split_regex(array_to_string(list_filter(list_transform(string_split({{}}, chr(10)), lambda x: {TRIM.format('x')}), "
    r"lambda x: x <> '' AND NOT starts_with(x, '{{') AND NOT starts_with(x, '[') AND NOT contains(lower(x), 'provenance') AND NOT contains(lower(x), 'graph_reasoning')), ' '), '\s+'), lambda w: w <> ''), ' ')"
)
TECHNICAL = " OR ".join(f"contains(lower(n), '{t}')" for t in ("{", "}", "[{", "graph_reasoning", "provenance", "offset_start", "offset_end", '"source"', "''source''", '"id"', "''id''"))
STOP = "['the', 'a', 'an', 'and', 'or', 'of', 'to', 'in', 'on', 'for', 'is', 'are', 'that', 'this', 'it', 'as', 'we', 'our', 'us', 'be', 'by', 'with', 'not', 'what', 'how', 'does', 'do', 'say', 'about']"
EVAL_TOKENS = f"list_distinct(list_filter(regexp_extract_all(lower(coalesce({{}}, '')), '[a-z0-9]+'), lambda w: NOT list_contains({STOP}, w)))"

SQL["sentence_clamp"] = rf"""WITH s AS (SELECT doc_id AS id, text, {SENTENCES.format('text')}[1:8] AS ss FROM documents),
k AS (SELECT *, list_transform(ss, lambda x: array_to_string(list_filter(string_split_regex(regexp_replace(lower(x), '[^a-z0-9\s]', '', 'g'), '\s+'), lambda w: w <> '')[1:10], ' ')) AS ks FROM s),
u AS (SELECT *, list_filter(ss, lambda x, i: list_position(ks, ks[i]) = i)[1:4] AS us FROM k),
j AS (SELECT id, text, CASE WHEN len(ss) = 0 THEN text ELSE array_to_string(CASE WHEN len(us) < 2 THEN ss[1:4] ELSE us END, ' ') END AS a FROM u),
n AS (SELECT id, {CLEAN.format('a')} AS answer, {CLEAN.format('text')} AS n FROM j)
SELECT id, answer, length(n) >= 40 AND NOT ({TECHNICAL}) AS natural FROM n"""

SQL["fallback_answer"] = f"""WITH {CORPUS}, {ASKED}, {POSTINGS}, {bm25('q', 's')}, r AS ({ranked('s', 3)}),
t AS (SELECT query_id, rank, {SENTENCES.format('text')}[1:2] AS ss FROM r JOIN c USING (id)),
f AS (SELECT query_id, flatten(list(ss ORDER BY rank))[1:2] AS ss FROM t GROUP BY query_id),
j AS (SELECT query_id, ss, array_to_string(ss, ' ') AS a FROM f)
SELECT query_id, CASE WHEN len(ss) = 0 THEN 'I could not find enough clean evidence to generate a natural answer.' ELSE {CLEAN.format('a')} END AS answer FROM j"""

SQL["eval_scores"] = f"""WITH {CORPUS}, {ASKED}, {POSTINGS}, {bm25('q', 's')}, r AS ({ranked('s', 6)}),
g AS (SELECT query_id, list(source ORDER BY rank) AS sources, first(text ORDER BY rank) AS answer FROM r JOIN c USING (id) GROUP BY query_id),
runs AS (SELECT query_id, CASE WHEN query_id % 2 = 0 THEN 'a' ELSE 'b' END AS config, sources, answer, (query_id % 5) / 5.0::DOUBLE AS conf, query_id % 9 = 0 AS bad FROM q LEFT JOIN g USING (query_id)),
truth AS (SELECT item_id AS query_id, CASE WHEN item_id % 4 = 3 THEN [] ELSE list_distinct(['src' || (item_id % 20), 'src' || (item_id * 3 % 20), 'src' || (item_id * 7 % 20)]) END AS want, CASE WHEN item_id % 3 = 0 THEN '' ELSE text END AS ref FROM benchmark),
m AS (SELECT runs.*, want, ref, len(list_filter(want, lambda x: coalesce(list_contains(sources[1:5], x), false)))::DOUBLE AS got, {EVAL_TOKENS.format('answer')} AS ta, {EVAL_TOKENS.format('ref')} AS tb FROM runs LEFT JOIN truth USING (query_id)),
o AS (SELECT *, len(list_intersect(ta, tb))::DOUBLE AS same FROM m)
SELECT config, count(*) AS n, count(*) FILTER (bad) AS errors, round(avg(got / len(want)) FILTER (NOT bad AND len(want) > 0), 6) AS recall,
 round(avg((got > 0)::INT::DOUBLE) FILTER (NOT bad AND len(want) > 0), 6) AS hit_rate,
 round(avg(CASE WHEN same = 0 THEN 0 ELSE 2 * (same / len(ta)) * (same / len(tb)) / (same / len(ta) + same / len(tb)) END) FILTER (NOT bad AND coalesce(ref, '') <> ''), 6) AS lexical_overlap,
 round(avg(conf) FILTER (NOT bad), 6) AS confidence FROM o GROUP BY config"""

SQL["graph_context"] = f"""WITH {GRAPH}, a AS (SELECT item_id AS query_id, o_orderkey AS chunk_id FROM benchmark JOIN orders ON o_custkey % 200 = item_id),
opp AS (SELECT claim_id, count(DISTINCT other) AS n FROM both_ GROUP BY claim_id),
sc AS (SELECT query_id, claim_id, count(DISTINCT chunk_id) AS k FROM a JOIN l USING (chunk_id) GROUP BY query_id, claim_id),
claims AS (SELECT query_id, claim_id, k AS support_count, coalesce(n, 0) AS c FROM (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY k DESC, claim_id) <= 10) LEFT JOIN opp USING (claim_id)),
m AS (SELECT DISTINCT query_id, chunk_id, name FROM a JOIN ce USING (chunk_id)),
density AS (SELECT query_id, name, count(*) AS n FROM m GROUP BY ALL),
relations AS (SELECT query_id, src, predicate, dst, n FROM density JOIN rel ON name = src QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, src, predicate, dst) <= 10),
sup AS (SELECT chunk_id, count(DISTINCT claim_id) AS s FROM l GROUP BY chunk_id), ent AS (SELECT chunk_id, count(*) AS e FROM ce GROUP BY chunk_id),
con_ AS (SELECT chunk_id, count(DISTINCT other) AS c FROM l JOIN both_ USING (claim_id) GROUP BY chunk_id),
scores AS (SELECT query_id, chunk_id, s, e, coalesce(c, 0) AS c FROM a JOIN sup USING (chunk_id) JOIN ent USING (chunk_id) LEFT JOIN con_ USING (chunk_id)),
ways AS (SELECT query_id, a.chunk_id, ke.name AS src, dst, count(*) AS n FROM a JOIN l ON l.chunk_id = a.chunk_id JOIN ke ON ke.claim_id = l.claim_id JOIN rel ON rel.src = ke.name GROUP BY query_id, a.chunk_id, ke.name, dst),
walks AS (SELECT * FROM ways QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, chunk_id, src, dst) <= 10)
SELECT query_id, part, key, value::DOUBLE AS value FROM (
  SELECT query_id, 'claims' AS part, claim_id || '|' || c AS key, support_count::DOUBLE AS value FROM claims
  UNION ALL SELECT query_id, 'contradicted', claim_id, c FROM claims WHERE c > 0
  UNION ALL SELECT query_id, 'entity_density', name, n FROM (SELECT * FROM density QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, name) <= 10)
  UNION ALL SELECT query_id, 'relations', concat_ws('|', src, predicate, dst), n FROM relations
  UNION ALL SELECT query_id, 'relation_strength', concat_ws('|', src, predicate, dst), sum(n) FROM relations GROUP BY query_id, src, predicate, dst HAVING sum(n) >= 2
  UNION ALL SELECT query_id, 'relation_conflicts', concat_ws('|', src, dst), count(DISTINCT predicate) FROM relations GROUP BY query_id, src, dst HAVING count(DISTINCT predicate) > 1
  UNION ALL SELECT query_id, 'evidence_scores', concat_ws('|', chunk_id, s, e, c), round(s + 0.1::DOUBLE * e - 0.5::DOUBLE * c, 3) FROM scores
  UNION ALL SELECT query_id, 'paths', concat_ws('|', chunk_id, src, dst), n FROM walks
  UNION ALL SELECT query_id, 'subgraph', concat_ws('|', chunk_id, name), 1 FROM (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY chunk_id, name) <= 50)
  UNION ALL SELECT query_id, 'signals', name, n FROM (SELECT DISTINCT query_id, 's' || (query_id + 1) AS name FROM a) JOIN (SELECT name, count(DISTINCT chunk_id) AS n FROM ce GROUP BY name) USING (name))"""

SQL["vector_index_topk"] = SQL["vector_topk"]
