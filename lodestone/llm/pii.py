"""Personal data by boosted trees over candidate spans, in DataFrame functions only.

Generators of high recall propose spans of an e-mail address or a number, in every format they
know. Numbers side by side are one run; its parts of whole groups of digits are proposed too. Features describe a candidate's format and the text around it. Boosted trees, fitted
here on labelled candidates of the formats below, give calibrated probabilities; a kind's threshold
is the lowest that kept its precision on the half that wasn't fitted. The trees are then one
expression over a candidate's features, evaluated by Spark.

Base spans are plain patterns with checks (at most 255, Luhn, digits). They always stay; the
trees add spans that overlap none of them. Overlapping additions are settled by the greater probability.

Offsets are code points, ends exclusive. They come from the lengths of what lies between the
matches: ``split`` and ``regexp_extract_all`` walk through the same matches.

The patterns are written so that long runs of digits or letters take linear time: possessive
where what follows can't begin with the same character, and not tried again inside a run.

Defined cases: a null text is empty and has no spans. Repeated rows and null ids keep a row each.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import boosting

KINDS = ("email", "ip", "card", "phone")
LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
AT = r"(?:@|\x20?[(\[]at[)\]]\x20?|\x20at\x20)"
DOT = r"(?:\.|\x20?[(\[]dot[)\]]\x20?|\x20dot\x20)"
GENERATORS = {
    "address": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++{AT}[A-Za-z0-9-]++(?:{DOT}[A-Za-z0-9-]++)++",
    "number": r"(?:\G|(?<![0-9A-Za-z]))[+(]?[0-9][0-9\x20().-]{5,}[0-9](?![0-9A-Za-z])",
}
BEFORE = 24
#: Matches of a text that are placed together.
BLOCK = 256
#: Digits that a part of a run may have: the fewest of a phone number, the most of a card.
LEAST, MOST = 9, 19
CONTEXT = {
    "c_phone": r"(?i)(?:tel|phone|call|mobile|fax|telefon|t.l.phone|tel.fono|dial)",
    "c_card": r"(?i)(?:card|visa|karte|carte|tarjeta|credit)",
    "c_mail": r"(?i)(?:mail|contact|write|reach)",
    "c_ip": r"(?i)(?:\bip\b|host|server|addr)",
    "c_other": r"(?i)(?:order|\bid\b|ref|isbn|version|page|invoice|\bno\b|sku)",
}


#: Plain tests that a text with a match passes. Most texts pass none, and no pattern is tried on them.
NEEDS = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike("[0-9]") & t.contains("."),
    "card": lambda t: t.rlike("[0-9]"),
    "phone": lambda t: t.contains("+"),
    "address": lambda t: t.contains("@") | t.contains("[at") | t.contains("(at") | t.contains(" at "),
    "number": lambda t: t.rlike("[0-9]"),
}
MATCH = "array<struct<s:int,e:int,m:string>>"


def with_matches(df: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """df plus ``_m_<name>``, array<struct<s, e, m>>: start, end and text of each match, leftmost and without overlap.

    The matches and what lies between them are columns first: within a lambda an expression
    would be evaluated again for each match.
    """
    t = F.col(text)
    found = {f"_f_{k}": F.when(NEEDS[k](t), F.regexp_extract_all(t, F.lit(p), F.lit(0))) for k, p in patterns.items()}
    df = df.withColumns(found)
    df = df.withColumns({f"_b_{k}": F.when(F.size(f"_f_{k}") > 0, F.split(t, p, -1)) for k, p in patterns.items()})
    empty = F.array().cast(MATCH)

    def spans(name: str) -> Column:
        pieces, hits = F.col(f"_b_{name}"), F.col(f"_f_{name}")
        sizes = F.zip_with(F.transform(F.slice(pieces, 1, F.size(hits)), F.length), hits, lambda n, m: F.struct(n.alias("n"), m.alias("m")))

        def step(acc: Column, x: Column) -> Column:
            s = acc["at"] + x["n"]
            e = s + F.length(x["m"])
            return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m")))).alias("out"))

        # An aggregate copies what it carries at each step, so it goes block by block.
        def block(z: Column, o: Column, k: Column) -> Column:
            start = F.struct(o["at"].alias("at"), empty.alias("out"))
            return F.aggregate(F.slice(z, k * BLOCK + 1, F.lit(BLOCK)), start, step, lambda a: F.struct(a["at"].alias("at"), F.concat(o["done"], F.array(a["out"])).alias("done")))

        none = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{MATCH}>").alias("done"))
        blocks = F.sequence(F.lit(0), F.floor(F.size(hits) / BLOCK).cast("int"))
        made = F.get(F.transform(F.array(sizes), lambda z: F.aggregate(blocks, none, lambda o, k: block(z, o, k), lambda o: F.flatten(o["done"]))), F.lit(0))
        return F.when(F.size(hits) > 0, made).otherwise(empty)

    return df.withColumns({f"_m_{k}": spans(k) for k in patterns}).drop(*(f"_{c}_{k}" for k in patterns for c in "fb"))


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits has a right check digit."""

    def step(total: Column, i: Column) -> Column:
        d = F.ascii(F.substring(number, F.length(number) - i, F.lit(1))) - 48
        twice = F.when(i % 2 == 1, d * 2).otherwise(d)
        return total + F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(0), F.length(number) - 1), F.lit(0), step) % 10 == 0


CHECKS = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(rf"^(?:{PART}\.){{3}}{PART}$"),
    "card": lambda m: F.when(F.length(digits(m)).between(12, 19), luhn(digits(m))).otherwise(F.lit(False)),
    "phone": lambda m: F.length(digits(m)).between(9, 15),
}


def base_spans() -> Column:
    """array<struct<s, kind, e>> of the matches that pass their check, by start, then kind."""
    def of(number: int, kind: str) -> Column:
        right = F.filter(f"_m_{kind}", lambda x: CHECKS[kind](x["m"]))
        return F.transform(right, lambda x: F.struct(x["s"].alias("s"), F.lit(number).alias("kind"), x["e"].alias("e")))

    parts = [of(i, k) for i, k in enumerate(KINDS)]
    return F.sort_array(F.concat(*parts))


def features(m: str, before: str, after: str) -> dict[str, str]:
    """SQL of a candidate's features, from SQL of its text and of what stands around it."""
    only = f"regexp_replace({m}, '[^0-9]', '')"
    count = lambda chars: f"(length({m}) - length(regexp_replace({m}, '[{chars}]', '')))"
    quoted = {k: v.replace("\\", "\\\\") for k, v in CONTEXT.items()}
    return {
        "n_chars": f"length({m})",
        "n_digits": f"length({only})",
        "n_groups": f"size(filter(split({m}, '[^0-9]+'), x -> x <> ''))",
        "longest": f"coalesce(array_max(transform(split({m}, '[^0-9]+'), x -> length(x))), 0)",
        "n_dots": count("."),
        "n_dashes": count("-"),
        "n_blanks": count(" "),
        "plus": f"IF(startswith({m}, '+'), 1, 0)",
        "paren": f"IF(contains({m}, '('), 1, 0)",
        "sign": f"IF(contains({m}, '@'), 1, 0)",
        "bracket": f"IF({m} RLIKE '[(\\\\[]at[)\\\\]]', 1, 0)",
        "last": f"length(regexp_extract({m}, '[A-Za-z]*$', 0))",
        # A part of a run is glued too if it begins behind a country code, or if a dash or dot leads on to the next group.
        "glued": f"IF({before} RLIKE '[A-Za-z0-9#$_.-]$|[+][0-9]{{1,3}}[ ().-]*$' OR {after} RLIKE '^([A-Za-z0-9%_]|[.-][0-9])', 1, 0)",
        **{k: f"IF({before} RLIKE '{v}', 1, 0)" for k, v in quoted.items()},
    }


USED = {
    "email": ("sign", "bracket", "last", "n_dots", "n_blanks", "glued", "c_mail", "n_digits"),
    "card": ("n_digits", "n_groups", "longest", "n_dots", "plus", "paren", "glued", "c_card", "c_phone", "c_other"),
    "phone": ("n_digits", "n_groups", "longest", "n_dots", "n_dashes", "n_blanks", "plus", "paren", "glued", "c_phone", "c_card", "c_other", "c_ip"),
}
FROM = {"email": "address", "card": "number", "phone": "number"}


def examples(kind: str, n: int = 1200, seed: int = 7) -> tuple[list[dict], list[int]]:
    """Labelled candidates of one kind: formats in which such data are written, and what looks like them. Bounded by n."""
    import random

    rng = random.Random(f"{kind}-{seed}")
    blank = dict.fromkeys((*features("m", "b", "a"),), 0)
    rows, labels = [], []

    def add(label: int, **x) -> None:
        rows.append(blank | x)
        labels.append(label)

    some = lambda p: int(rng.random() < p)
    for _ in range(n // 4):
        if kind == "email":
            add(1, sign=0, bracket=1, last=rng.choice([2, 3, 3, 4]), n_dots=rng.randint(0, 2), n_blanks=rng.randint(0, 4), c_mail=some(0.4), n_digits=rng.randint(0, 4))
            add(1, sign=0, bracket=0, last=rng.choice([2, 3, 3]), n_dots=rng.randint(0, 1), n_blanks=rng.randint(2, 4), c_mail=1, n_digits=rng.randint(0, 4))
            add(0, sign=0, bracket=0, last=rng.randint(0, 9), n_dots=rng.randint(0, 3), n_blanks=rng.randint(2, 4), c_mail=some(0.05), n_digits=rng.randint(0, 6), glued=some(0.3))
            add(0, sign=0, bracket=0, last=rng.randint(0, 9), n_dots=rng.randint(0, 2), n_blanks=2, c_mail=0, n_digits=rng.randint(0, 9))
        elif kind == "card":
            add(1, n_digits=16, n_groups=rng.choice([1, 1, 4]), longest=0, c_card=some(0.3))
            add(1, n_digits=rng.choice([13, 14, 15, 16, 19]), n_groups=rng.choice([1, 3, 4]), c_card=1, glued=0)
            add(0, n_digits=rng.randint(7, 20) if some(0.5) else rng.randint(17, 60), n_groups=rng.randint(1, 7), glued=some(0.7), n_dots=rng.randint(0, 3), c_other=some(0.5), plus=some(0.2), paren=some(0.2))
            add(0, n_digits=rng.choice([8, 9, 10, 11, 12, 13, 14, 17, 18]), n_groups=rng.randint(1, 5), c_phone=some(0.3), c_other=some(0.3))
            for r in rows[-4:-2]:
                r["longest"] = r["n_digits"] if r["n_groups"] == 1 else 4 if r["n_groups"] == 4 else 6
            for r in rows[-2:]:
                r["longest"] = max(-(-r["n_digits"] // r["n_groups"]), rng.randint(1, r["n_digits"]))
            # Cut out of longer numbers.
            add(0, n_digits=rng.randint(12, 19), n_groups=rng.randint(1, 7), longest=rng.randint(4, 16), c_card=some(0.6), c_phone=some(0.2), paren=some(0.3), glued=1)
        else:
            g = rng.choice([3, 3, 4])
            add(1, n_digits=rng.choice([10, 10, 11]), n_groups=g, longest=4, n_dashes=g - 1 if some(0.5) else 0, n_blanks=rng.randint(0, g - 1), paren=some(0.5), c_phone=some(0.3))
            add(1, n_digits=rng.randint(9, 13), n_groups=rng.randint(1, 6), longest=rng.randint(2, 10), n_blanks=rng.randint(0, 4), c_phone=1, plus=some(0.3))
            add(0, n_digits=rng.randint(6, 20) if some(0.5) else rng.randint(14, 60), n_groups=rng.randint(1, 6), longest=rng.randint(1, 16), n_dots=rng.randint(0, 4), n_dashes=some(0.5), c_other=some(0.6), c_ip=some(0.1), glued=some(0.5))
            add(0, n_digits=8, n_groups=3, longest=4, n_dashes=2, c_other=some(0.2))
            add(0, n_digits=rng.randint(9, 19), n_groups=rng.randint(1, 6), longest=rng.randint(2, 10), n_dashes=rng.randint(0, 3), n_blanks=rng.randint(0, 4), paren=some(0.4), c_phone=some(0.6), glued=1)
    order = list(range(len(rows)))
    rng.shuffle(order)
    return [rows[i] for i in order], [labels[i] for i in order]


@cache
def model(kind: str) -> boosting.Boosted:
    rows, labels = examples(kind)
    return boosting.fit([{k: r[k] for k in USED[kind]} for r in rows], labels)


def with_candidates(df: DataFrame) -> DataFrame:
    """df plus ``_address`` and ``_number``, array<struct<s, e, m, b, a>>: candidates that overlap no base span, with the text around them.

    A run of numbers is proposed whole, and so is each sequence of its groups of digits that has
    LEAST to MOST digits, with the sign or bracket before it, unless it ends within brackets that it
    opens. A group begins at most MOST of them.
    """
    before = lambda s: f"substring(_text, greatest({s} - {BEFORE} + 1, 1), least({s}, {BEFORE}))"
    free = lambda x: f"NOT exists(base_spans, y -> y.s < {x}.e AND {x}.s < y.e)"
    whole = lambda name: f"transform(_m_{name}, x -> named_struct('s', x.s, 'e', x.e, 'm', x.m, 'b', {before('x.s')}, 'a', substring(_text, x.e + 1, 2)))"
    df = df.withColumns({f"_w_{name}": F.expr(whole(name)) for name in GENERATORS})
    # Groups of each run: p is the text since the last group, n the digits.
    piece = "named_struct('p', p, 'n', length(regexp_extract(p, '[0-9]+$', 0)), 'w', length(regexp_extract(p, '[+(]?[0-9]+$', 0)))"
    pieces = f"transform(regexp_extract_all(x.m, '[^0-9]*[0-9]+', 0), p -> {piece})"
    none = "cast(array() as array<struct<p:string,n:int,w:int,e:int>>)"
    placed = f"aggregate({pieces}, named_struct('at', x.s, 'out', {none}), (acc, g) -> named_struct('at', acc.at + length(g.p), 'out', concat(acc.out, array(named_struct('p', g.p, 'n', g.n, 'w', g.w, 'e', acc.at + length(g.p))))), acc -> acc.out)"
    df = df.withColumn("_g_number", F.expr(f"transform(_m_number, x -> named_struct('s', x.s, 'e', x.e, 'g', {placed}))"))
    around = f"transform(x.g, g -> named_struct('p', g.p, 'n', g.n, 'w', g.w, 's', g.e - g.w, 'e', g.e, 'b', {before('(g.e - g.w)')}, 'a', substring(_text, g.e + 1, 2)))"
    df = df.withColumn("_g_number", F.expr(f"transform(_g_number, x -> named_struct('s', x.s, 'e', x.e, 'g', {around}))"))
    digits = "aggregate(slice(x.g, i + 1, k + 1), 0, (n, h) -> n + h.n)"
    joined = "array_join(slice(x.g, i + 1, k + 1).p, '')"
    part = f"named_struct('n', {digits}, 's', f.s, 'e', l.e, 'm', {joined}, 'b', f.b, 'a', l.a)"
    some = f"filter(transform(slice(x.g, i + 1, {MOST}), (l, k) -> {part}), c -> c.n BETWEEN {LEAST} AND {MOST} AND NOT (c.s = x.s AND c.e = x.e) AND NOT (c.e < x.e AND startswith(c.a, ')') AND c.m RLIKE '[(][^)]*$'))"
    parts = f"flatten(transform(_g_number, x -> flatten(transform(x.g, (f, i) -> {some}))))"
    cut = "transform(_p_number, c -> named_struct('s', c.s, 'e', c.e, 'm', right(c.m, c.e - c.s), 'b', c.b, 'a', c.a))"
    df = df.withColumn("_p_number", F.expr(parts))
    df = df.withColumns({"_address": F.expr(f"filter(_w_address, x -> {free('x')})"), "_number": F.expr(f"filter(concat(_w_number, {cut}), x -> {free('x')})")})
    return df.drop("_g_number", "_p_number", *(f"_w_{name}" for name in GENERATORS))


def with_spans(df: DataFrame, text: str = "text") -> DataFrame:
    """df plus ``base_spans`` and ``spans``, both array<struct<s, kind, e>> in order."""
    patterns = BASE | GENERATORS
    df = with_matches(df.withColumn("_text", F.coalesce(F.col(text), F.lit(""))), "_text", patterns)
    df = df.withColumn("base_spans", base_spans())
    df = with_candidates(df)
    wanted = []
    for i, kind in enumerate(KINDS):
        if kind not in USED:
            continue
        source, trees = f"_{FROM[kind]}", model(kind)
        names = features("c.m", "c.b", "c.a")
        held = ", ".join(f"'{k}', {names[k]}" for k in USED[kind])
        scored = f"transform({source}, c -> named_struct('s', c.s, 'e', c.e, 'f', named_struct({held})))"
        p = trees.sql()
        for k in sorted(USED[kind], key=len, reverse=True):
            p = p.replace(f"IF({k} ", f"IF(f.f.{k} ")
        wanted.append(f"filter(transform({scored}, f -> named_struct('p', -{p}, 's', f.s, 'kind', {i}, 'e', f.e)), y -> -y.p >= {trees.threshold!r}D)")
    none = "cast(array() as array<struct<p:double,s:int,kind:int,e:int>>)"
    some = " OR ".join(f"size(_{g}) > 0" for g in GENERATORS)
    best = f"sort_array(concat({', '.join(wanted)}))"
    apart = f"aggregate({best}, {none}, (a, y) -> IF(exists(a, z -> z.s < y.e AND y.s < z.e), a, concat(a, array(y))))"
    df = df.withColumn("_added", F.expr(f"IF({some}, {apart}, {none})"))
    spans = F.sort_array(F.concat(F.col("base_spans"), F.expr("transform(_added, y -> named_struct('s', y.s, 'kind', y.kind, 'e', y.e))")))
    return df.withColumn("spans", spans).drop("_text", "_added", *(f"_{g}" for g in GENERATORS), *(f"_m_{k}" for k in patterns))


def digest(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["s"], x["e"])), ",")


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """df with every span replaced by its kind in brackets; of overlapping spans the earlier and longer. Needs ``spans``."""
    kinds = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        piece = F.substring(F.col(text), acc["at"] + 1, x["s"] - acc["at"])
        put = F.struct(x["e"].alias("at"), F.concat(acc["out"], F.array(piece, F.get(kinds, x["kind"]))).alias("out"))
        longer = F.struct(F.greatest(acc["at"], x["e"]).alias("at"), acc["out"].alias("out"))
        return F.when(x["s"] >= acc["at"], put).otherwise(longer)

    done = F.aggregate("spans", start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(F.col(text), acc["at"] + 1, F.length(text))))
    return df.withColumn(text, F.when(F.col(text).isNull() | (F.size("spans") == 0), F.col(text)).otherwise(done))


def op9_pii_spans(spark, sf_dir: str) -> DataFrame:
    """Counts and digest of the base spans, and all spans, of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    count = lambda i: F.size(F.filter("base_spans", lambda x: x["kind"] == i)).cast("long")
    return rows.select(
        "doc_id", *(count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)),
        F.sha2(digest(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"),
    )
