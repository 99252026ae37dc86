"""Text functions as Column expressions: everything stays in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# They must be as they are for right results.
#: White space as a Unicode-aware split sees it; Java's own class is narrower.
WHITE = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
BASE_STOPWORDS = ("a", "an", "the", "and", "or", "of", "to", "in", "on", "for", "with", "what", "why", "how", "who", "where", "when", "which", "whom", "whose")
EVAL_STOPWORDS = ("the", "a", "an", "and", "or", "of", "to", "in", "on", "for", "is", "are", "that", "this", "it", "as", "we", "our", "us", "be", "by", "with", "not", "what", "how", "does", "do", "say", "about")
NEGATORS = (" not ", " no ", " never ", " cannot ", " can't ", " won't ", " isn't ", " aren't ", " wasn't ", " weren't ")
PREDICATES = (" is ", " are ", " has ", " have ", " causes ", " leads to ", " supports ")
TECHNICAL = ("{", "}", "[{", "graph_reasoning", "provenance", "offset_start", "offset_end", '"source"', "'source'", '"id"', "'id'")
ID_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"
NO_EVIDENCE = "I could not find enough clean evidence to generate a natural answer."


def literals(values: Sequence[str]) -> Column:
    return F.array(*(F.lit(v) for v in values)) if values else F.array().cast("array<string>")


def any_in(text: Column, values: Sequence[str]) -> Column:
    """Whether text contains any of some literals."""
    out = F.lit(False)
    for v in values:
        out = out | F.contains(text, F.lit(v))
    return out


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words(text: Column) -> Column:
    """Words between white space, none empty."""
    return F.filter(F.split(text, WHITE), lambda w: w != "")


def squeezed(text: Column) -> Column:
    """Lower case, words joined by single blanks: the form in which texts are compared."""
    return F.array_join(words(F.lower(text)), " ")


def strip(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"^{WHITE}", ""), f"{WHITE}$", "")


def falsy(value: Column, empty) -> Column:
    """Null where the value is empty in the sense of a dynamic language (0, '', [])."""
    return F.nullif(value, F.lit(empty))


# -- ids ----------------------------------------------------------------------------------


def name_uuid(name: Column) -> Column:
    """Name-based UUID (version 5) in the URL namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(ID_NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(F.lit(0x3F)).bitwiseOR(F.lit(0x80))))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 19, 2)), F.substring(h, 21, 12))


def namespace(kind: str, tenant: Column, domain: Column) -> Column:
    """Collection or index name: base_domain, else base_tenant, else base."""
    name = F.coalesce(falsy(domain, ""), falsy(tenant, ""))
    return F.when(name.isNull(), F.lit(kind)).otherwise(F.concat(F.lit(kind + "_"), name))


def base_name(source: Column) -> Column:
    """Last part of a path, trimmed and lower case."""
    return F.coalesce(F.lower(strip(F.element_at(F.split(F.replace(source, F.lit("\\"), F.lit("/")), "/"), -1))), F.lit(""))


# -- query text ---------------------------------------------------------------------------


def comma_list(value: Column) -> Column:
    """Trimmed lower-case parts of a comma list, none empty."""
    return F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), ","), lambda x: F.lower(strip(x))), lambda x: x != "")


def query_tokens(text: Column) -> Column:
    """Lower-case words of more than two characters."""
    return F.filter(words(F.lower(text)), lambda w: F.length(w) > 2)


def author_mentions(query: Column, names: Sequence[str], stopwords: Sequence[str] = ()) -> Column:
    """Known names in the query, sorted; else its capitalised words that aren't stopwords, sorted."""
    stop = literals(tuple(dict.fromkeys((*BASE_STOPWORDS, *stopwords))))
    known = literals(sorted({n.lower() for n in names if len(n) >= 3} - {*BASE_STOPWORDS, *stopwords}))
    found = F.filter(known, lambda n: F.contains(F.lower(query), n))
    proper = F.filter(F.regexp_extract_all(query, F.lit(r"[A-Za-z][A-Za-z\-]+"), F.lit(0)), lambda w: w.rlike("^[A-Z]") & (F.length(w) >= 3))
    loose = F.array_sort(F.array_distinct(F.filter(F.transform(proper, F.lower), lambda w: ~F.array_contains(stop, w))))
    return F.when(F.size(found) > 0, found).otherwise(loose)


def query_terms(query: Column, authors: Column, synonyms: dict[str, list[str]] | None = None, stopwords: Sequence[str] = ()) -> Column:
    """Words of three letters and more that aren't stopwords or authors, each followed by its synonyms; first occurrences only."""
    stop = literals(tuple(dict.fromkeys((*BASE_STOPWORDS, *stopwords))))
    tokens = F.regexp_extract_all(F.lower(query), F.lit(r"[a-z][a-z\-]+"), F.lit(0))
    kept = F.filter(tokens, lambda w: (F.length(w) >= 3) & ~F.array_contains(stop, w) & ~F.array_contains(authors, w))
    if not synonyms:
        return F.array_distinct(kept)
    entries = F.create_map(*(x for k, v in synonyms.items() for x in (F.lit(k), literals(v))))
    return F.array_distinct(F.flatten(F.transform(kept, lambda w: F.concat(F.array(w), F.coalesce(F.try_element_at(entries, w), F.array().cast("array<string>"))))))


def cache_key(query: Column, preferences: Column, tenant: Column, policy: str = "") -> Column:
    """SHA-256 over the squeezed query, key-sorted preferences (a map), tenant and policy signature."""
    prefs = F.to_json(F.array_sort(F.map_entries(preferences)))
    return F.sha2(F.to_json(F.struct(squeezed(query).alias("query"), prefs.alias("prefs"), tenant.alias("tenant"), F.lit(policy).alias("policy"))).cast("binary"), 256)


# -- structured lines ---------------------------------------------------------------------


def structured_lines(text: Column, tokens: Column, most: int, chars: int = 400) -> Column:
    """Lines with a separator and, if there are tokens, any of them; a tabular line counts twice."""
    lines = F.transform(F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), strip)
    good = F.filter(lines, lambda x: x.rlike(r"[:|\t,]") & ((F.size(tokens) == 0) | F.exists(tokens, lambda t: F.contains(F.lower(x), t))))
    tabular = lambda x: (F.regexp_count(x, F.lit(",")) >= 2) | (F.regexp_count(x, F.lit(r"\|")) >= 2) | F.contains(x, F.lit("\t"))
    cut = lambda x: F.substring(x, 1, chars)
    return F.slice(F.flatten(F.transform(good, lambda x: F.when(tabular(x), F.array(cut(x), cut(x))).otherwise(F.array(cut(x))))), 1, most)


# -- answers ------------------------------------------------------------------------------


def json_body(text: Column) -> Column:
    """From the first { to the last }, if that is valid JSON."""
    body = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(body).isNotNull() & (body != ""), body)


def answer_sentences(text: Column, most: int) -> Column:
    """Sentences of 20 characters and more that begin with a capital."""
    parts = F.transform(F.split(strip(F.coalesce(text, F.lit(""))), rf"(?<=[.!?]){WHITE}"), strip)
    return F.slice(F.filter(parts, lambda s: (F.length(s) >= 20) & s.rlike("^[A-Z]")), 1, most)


def sentence_key(sentence: Column) -> Column:
    """First ten words without punctuation: equal for near duplicates."""
    plain = F.regexp_replace(F.lower(sentence), r"[^a-z0-9\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]", "")
    return F.array_join(F.slice(words(plain), 1, 10), " ")


def clean_answer(text: Column) -> Column:
    """Text without blank, structured and log lines, white space collapsed."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), strip)
    bad = lambda x: F.startswith(x, F.lit("{")) | F.startswith(x, F.lit("[")) | F.contains(F.lower(x), F.lit("provenance")) | F.contains(F.lower(x), F.lit("graph_reasoning"))
    return F.array_join(words(F.array_join(F.filter(lines, lambda x: (x != "") & ~bad(x)), " ")), " ")


def clamp_answer(text: Column, least: int = 2, most: int = 4) -> Column:
    """Two to four sentences of which no two have the same key."""
    start = F.struct(F.array().cast("array<string>").alias("keys"), F.array().cast("array<string>").alias("kept"))

    def step(acc: Column, s: Column) -> Column:
        def taken(key: Column) -> Column:
            fresh = ~F.array_contains(acc["keys"], key) & (F.size(acc["kept"]) < most)
            return F.when(fresh, F.struct(F.concat(acc["keys"], F.array(key)).alias("keys"), F.concat(acc["kept"], F.array(s)).alias("kept"))).otherwise(acc)

        return once(sentence_key(s), taken)

    def chosen(found: Column) -> Column:
        unique = F.aggregate(found, start, step, lambda acc: acc["kept"])
        kept = once(unique, lambda u: F.when(F.size(u) < least, F.slice(found, 1, most)).otherwise(u))
        return F.when(F.size(found) == 0, text).otherwise(F.array_join(kept, " "))

    return clean_answer(once(answer_sentences(text, 8), chosen))


def technical(text: Column) -> Column:
    return F.coalesce(text == "", F.lit(True)) | once(F.lower(text), lambda t: any_in(t, TECHNICAL))


def natural(text: Column) -> Column:
    return once(clean_answer(text), lambda cleaned: (F.length(cleaned) >= 40) & ~technical(cleaned))


def fallback_answer(texts: Column, authors: Column, gap: Column) -> Column:
    """First two clean sentences of an ordered array of texts; under a gap with a note on it."""
    found = F.slice(F.flatten(F.transform(texts, lambda t: answer_sentences(strip(F.coalesce(t, F.lit(""))), 2))), 1, 2)
    note = F.concat(F.lit("No direct passages from "), F.array_join(authors, ", "), F.lit(" mention the query keywords in the current dataset. "))
    body = F.array_join(found, " ")
    said = F.when(gap & (F.size(authors) > 0), F.concat(note, body)).otherwise(body)
    return F.when(F.size(found) == 0, F.lit(NO_EVIDENCE)).otherwise(clean_answer(said))


# -- claims -------------------------------------------------------------------------------


def claims(text: Column, most: int = 5) -> Column:
    """First sentences, split at full stops."""
    parts = F.transform(F.split(F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(" ")), r"\."), strip)
    return F.slice(F.filter(parts, lambda s: s != ""), 1, most)


def negated(text: Column) -> Column:
    return any_in(F.concat(F.lit(" "), F.lower(text), F.lit(" ")), NEGATORS)


def token_set(text: Column) -> Column:
    """Distinct alphabetic words of more than two letters."""
    return F.array_distinct(F.filter(words(F.regexp_replace(F.lower(text), "[,;:]", " ")), lambda w: w.rlike(r"^\p{L}+$") & (F.length(w) > 2)))


def needed_overlap(a: Column, b: Column, share: float = 0.6, floor: int = 3) -> Column:
    return F.greatest(F.lit(floor), F.floor(F.lit(share) * F.least(F.size(a), F.size(b))))


def rough_match(a: Column, b: Column, share: float = 0.6, floor: int = 3) -> Column:
    """Whether two token sets overlap as paraphrases do."""
    return (F.size(a) > 0) & (F.size(b) > 0) & (F.size(F.array_intersect(a, b)) >= needed_overlap(a, b, share, floor))


def numbers(text: Column) -> Column:
    """Values of maximal runs of digits and points; what doesn't parse is dropped."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"[\d.]+"), F.lit(0)), lambda x: x.try_cast("double")), lambda x: x.isNotNull())


def shares_entity(a: Column, b: Column, entities: Column) -> Column:
    return F.exists(entities, lambda e: F.contains(F.lower(a), F.lower(e)) & F.contains(F.lower(b), F.lower(e)))


def first_predicate(text: Column) -> Column:
    """The first of the fixed predicates that the text has."""
    out = F.lit(None).cast("string")
    for p in reversed(PREDICATES):
        out = F.when(F.contains(F.lower(text), F.lit(p)), F.lit(p.strip())).otherwise(out)
    return out


# -- evaluation ---------------------------------------------------------------------------


def eval_tokens(text: Column) -> Column:
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_except(F.array_distinct(found), literals(EVAL_STOPWORDS))


def lexical_overlap(a: Column, b: Column) -> Column:
    """F1 of two texts' token sets."""
    x, y = eval_tokens(a), eval_tokens(b)
    both = F.size(F.array_intersect(x, y))
    return F.when(both == 0, F.lit(0.0)).otherwise(2.0 * (both / F.size(x)) * (both / F.size(y)) / (both / F.size(x) + both / F.size(y)))


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def cursor(created_at: Column, row_id: Column) -> Column:
    return F.concat(created_at.cast("string"), F.lit("|"), row_id.cast("string"))
