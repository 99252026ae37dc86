"""URL filters: rules of a host and a path, found by short hash prefixes and confirmed by full digests.

A URL's host is what stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, in lower
case (A-Z only); its path follows up to ``?``, ``#`` or the end. A rule fits its host and all
subdomains if the path starts with the rule's. Of fitting rules the longest decides (host and
path together, then the longer host), of equal ones the one that blocks.

A URL becomes one expression for each suffix of its host, which is looked up among the hosts of
rules; of each host found, one for each length that a path of its rules has. Both look-ups are
equi-joins on the first PREFIX hexadecimal digits of a digest, and what meets is confirmed on the
whole digest. Expressions of a URL are next to each other, so they are summed up to a row within
their task before the only shuffle, which is dealt by row. Rules are broadcast up to
BROADCAST_RULES; beyond, both look-ups are shuffled joins in which a host's rows are dealt over
SALTS parts, so a host with a third of all pages isn't one task's.

Defined cases: a null URL, or one without ``://``, has an empty host and path, fits no rule and
gets the default verdict. Repeated rows keep a row each. Rules that are null, or whose path
doesn't start with ``/`` and isn't empty, fit nothing. An empty table gives one. Very long URLs
are taken whole: only suffixes with as many labels as some rule has, and prefixes as long as some
rule's, are ever made. Other columns of pages are dropped, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PREFIX = 8
#: So many rules may be broadcast; their digests and texts take some hundred bytes each.
BROADCAST_RULES = 50_000
SALTS = 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Host, path, verdict.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    each = [F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules]
    return spark.range(1).select(F.inline(F.array(*each)))


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL."""
    rest = F.when(F.contains(url, F.lit("://")), F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def digest(expression: Column) -> Column:
    return F.sha2(expression, 256)


def look_up(rows: DataFrame, expression: Column, table: DataFrame, wide: bool) -> DataFrame:
    """rows with the columns of table(digest, …) where the expression's digest is there; null ones elsewhere."""
    asked = rows.withColumn("_d", digest(expression)).withColumn("_p", F.substring("_d", 1, PREFIX))
    held = table.withColumn("_hp", F.substring("digest", 1, PREFIX))
    on = (F.col("_p") == F.col("_hp")) & (F.col("_d") == F.col("digest"))
    if wide:
        asked = asked.withColumn("_s", F.pmod(F.xxhash64("_row"), F.lit(SALTS)).cast("int"))
        held = held.withColumn("_hs", F.explode(F.array(*map(F.lit, range(SALTS)))))
        on = on & (F.col("_s") == F.col("_hs"))
        found = asked.join(held.hint("merge"), on, "left")
    else:
        found = asked.join(F.broadcast(held), on, "left")
    return found.drop("_d", "_p", "_hp", "_s", "_hs", "digest")


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", most: int = BROADCAST_RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) of pages(page_id, url) under rules(host, path, verdict)."""
    clean = rules.select(F.translate("host", UPPER, LOWER).alias("_rh"), F.col("path").alias("_rp"), (F.col("verdict") == "block").alias("_rb"))
    clean = clean.where(F.col("_rh").isNotNull() & ((F.col("_rp") == "") | F.startswith("_rp", F.lit("/"))))
    shape = clean.agg(F.count("*").alias("n"), F.collect_set(F.size(F.split("_rh", r"\."))).alias("labels")).first()  # as many as a host has labels at most
    wide = shape["n"] > most
    hosts = clean.groupBy(digest(F.col("_rh")).alias("digest")).agg(F.array_sort(F.collect_set(F.length("_rp"))).alias("_sizes"))
    keys = clean.groupBy(digest(F.concat("_rh", "_rp")).alias("digest")).agg(F.max(F.col("_rb").cast("long")).alias("_block"))

    host, path = parts(F.coalesce("url", F.lit("")))
    base = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("_row", F.monotonically_increasing_id())
    labels = F.split("host", r"\.")
    depth = F.filter(F.array(*(F.lit(n) for n in sorted(shape["labels"]))).cast("array<int>"), lambda n: n <= F.size(labels))
    suffixes = F.transform(depth, lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."))
    each = look_up(base.withColumn("_h", F.explode_outer(suffixes)), F.col("_h"), hosts, wide)
    sizes = F.filter("_sizes", lambda n: n <= F.length("path"))
    each = each.withColumn("_n", F.explode_outer(sizes)).drop("_sizes")
    each = look_up(each, F.concat("_h", F.expr("left(path, _n)")), keys, wide)
    # one number orders the rules that fit a URL, and says where they end in it
    rank = (F.length("_h") + F.col("_n")).cast("long") * F.lit(1 << 32) + F.length("_h").cast("long") * 2 + F.col("_block")
    best = each.groupBy("_row", "page_id", "host", "path").agg(F.max(rank).alias("_k"))
    size = F.shiftright(F.col("_k").bitwiseAND(F.lit((1 << 32) - 1)), 1).cast("int")
    whole = F.shiftright("_k", 32).cast("int")
    best = best.withColumns({"_hn": size, "_pn": whole - size})
    return best.select(
        "page_id", "host", "path", F.when(F.col("_k").isNotNull(), F.concat(F.expr("right(host, _hn)"), F.expr("left(path, _pn)"))).alias("rule"),
        F.when(F.col("_k").isNull(), F.lit(default)).when(F.col("_k").bitwiseAND(F.lit(1)) == 1, "block").otherwise("allow").alias("verdict"),
    )


def op13_url_filters(spark, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), rule_table(spark))
