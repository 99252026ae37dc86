"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from lodestone.llm.alignment import op12_token_alignment
from lodestone.llm.counts import op6_viterbi_counts
from lodestone.llm.fingerprints import op5_bottom_k
from lodestone.llm.lattice import op7_relational_lattice
from lodestone.llm.neardup import op4_hamming_minhash
from lodestone.llm.packing import op8_best_two_fit
from lodestone.llm.phrases import op11_phrases
from lodestone.llm.pii import op9_pii_spans
from lodestone.llm.quality import op1_quality_rules
from lodestone.llm.sharding import op2_kd_shards
from lodestone.llm.tokens import op3_token_codes
from lodestone.llm.toxicity import op10_toxicity_crf
from lodestone.llm.urls import RULES, UPPER, op13_url_filters

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_kd_shards": op2_kd_shards,
    "op3_token_codes": op3_token_codes,
    "op4_hamming_minhash": op4_hamming_minhash,
    "op5_bottom_k": op5_bottom_k,
    "op6_viterbi_counts": op6_viterbi_counts,
    "op7_relational_lattice": op7_relational_lattice,
    "op8_best_two_fit": op8_best_two_fit,
    "op9_pii_spans": op9_pii_spans,
    "op10_toxicity_crf": op10_toxicity_crf,
    "op11_phrases": op11_phrases,
    "op12_token_alignment": op12_token_alignment,
    "op13_url_filters": op13_url_filters,
}

#: DuckDB's SQL for the same rows.
SQL = {
    "op1_quality_rules": r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d
), starts AS (
  SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS win
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM starts) WHERE n > 1
), covered AS (
  SELECT rid, count(DISTINCT i + j) AS n FROM twice, range(0, 8) AS r(j) GROUP BY rid
), lines AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup
  FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid
), m AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines,
    CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS BIGINT) AS n_upper,
    CAST(length(t) - length(regexp_replace(t, '[a-z]', '', 'g')) AS BIGINT) AS n_lower
  FROM w LEFT JOIN lines USING (rid) LEFT JOIN covered USING (rid)
), b AS (
  SELECT *, CAST((n_words < 20)::INT + 2 * (n_repeat_words * 100 > n_words * 30)::INT
    + 4 * (n_symbols * 100 > n_words * 25)::INT + 8 * (n_dup_lines * 100 > n_lines * 50)::INT
    + 16 * (n_upper * 100 > (n_upper + n_lower) * 50)::INT + 32 * (word_chars > n_words * 16)::INT AS BIGINT) AS failed_bits
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_bits & 3) <> 0 AS base_failed,
  (failed_bits & 31) = 0 AS kept, failed_bits, n_lines, n_upper, n_lower
FROM b
""",
    "op4_hamming_minhash": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), g AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (
  SELECT doc_id AS id, doc_id AS label FROM documents UNION SELECT e.b, r.label FROM r JOIN e ON e.a = r.id
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.label AS component_id, d.doc_id = c.label AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(label) AS label FROM r GROUP BY id) c ON c.id = d.doc_id
""",
    "op11_phrases": r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), p AS (
  SELECT lang, regexp_extract_all(unnest(string_split_regex(t, '[.,;:!?\n-\r]')), '[^ \t]+') AS ws FROM d
), n AS (
  SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM p GROUP BY lang
), f AS (
  SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM p, range(1, 6) AS r(m) WHERE len(ws) >= m) GROUP BY ALL
), c AS (
  SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE m > 1 AND f >= 100
), k AS (
  SELECT lang, m, phrase, a, ws, unnest(range(1, m)) AS k FROM c
), s AS (
  SELECT k.lang, k.phrase, a, k, x.f AS l, y.f AS r, n, CAST((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM k JOIN n USING (lang) JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(ws[1:k], ' ') JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(ws[k + 1:], ' ')
), low AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inner_ AS (
  SELECT lang, array_to_string(ws[i:i + j - 1], ' ') AS phrase, max(a) AS f
  FROM (SELECT lang, ws, a, j, unnest(range(1, m - j + 2)) AS i FROM c, range(2, 5) AS r(j) WHERE j < m) GROUP BY ALL
), kept AS (
  SELECT low.* FROM low LEFT JOIN inner_ USING (lang, phrase) WHERE coalesce(100 * f < 100 * a, true)
)
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) WHERE rank <= 2000
""",
    "op13_url_filters": rf"""
WITH r(h, p, v) AS (
  VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)}
), u AS (
  SELECT row_number() OVER () AS rid, page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), s AS (
  SELECT rid, page_id, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM u
), x AS (
  SELECT rid, page_id, translate(h, '{UPPER}', '{UPPER.lower()}') AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM s
), m AS (
  SELECT x.*, r.*, row_number() OVER (PARTITION BY rid ORDER BY length(h || p) DESC, length(h) DESC) AS place
  FROM x LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
)
SELECT page_id, host, path, h || p AS rule, coalesce(v, 'allow') AS verdict FROM m WHERE place = 1
""",
}
