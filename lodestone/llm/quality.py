"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document. The ledger keeps what was measured and one
failure bit for each rule; a policy is a versioned mask over these bits, so trying another
policy, or leaving a rule out, reads the ledger and never the texts again.

Defined cases: a null text has no words; every measurement is then 0, and rules on ratios
pass. Repeated rows and null ids each give a row of their own. Columns other than the id and
the text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import arrow_rows, raw_texts

SPACE = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
CONTINUATION = bytes(range(0x80, 0xC0))
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
WINDOW = 8

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_lower")


@dataclass(frozen=True)
class Rule:
    """A rule fails where ``fails`` is true. The bit is its fixed place in the ledger and is never used again for another rule."""

    bit: int
    name: str
    fails: Callable[[], Column]


RULES = (
    Rule(0, "few_words", lambda: F.col("n_words") < 20),
    Rule(1, "repeated_words", lambda: F.col("n_repeat_words") * 100 > F.col("n_words") * 30),
    Rule(2, "symbols", lambda: F.col("n_symbols") * 100 > F.col("n_words") * 25),
    Rule(3, "repeated_lines", lambda: F.col("n_dup_lines") * 100 > F.col("n_lines") * 50),
    Rule(4, "capitals", lambda: F.col("n_upper") * 100 > (F.col("n_upper") + F.col("n_lower")) * 50),
    Rule(5, "long_words", lambda: F.col("word_chars") > F.col("n_words") * 16),
)

BASE = 0b11

#: Versions of the policy: the bits that reject a document.
POLICIES = {"v1": BASE, "v2": 0b11111, "v3": 0b111111}
CURRENT = "v2"


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words covered by windows of words that occur twice or more."""
    import numpy as np

    n = len(words)
    if n <= window:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.uint64, n)
    if len(ids) > n - window:  # fewer repeated words than a second window needs
        return 0
    h = np.zeros(n - window + 1, np.uint64)
    for j in range(window):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[j : n - window + 1 + j] + np.uint64(1)
        h ^= h >> np.uint64(29)
    s = np.sort(h)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(h, twice))
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(raw: bytes | None) -> tuple[int, ...]:
    """MEASURES of one text."""
    if not raw:
        return (0,) * len(MEASURES)
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    gone = lambda chars: len(raw) - len(raw.translate(None, chars))
    return (
        len(words),
        len(raw.translate(None, SPACE + CONTINUATION)),
        gone(SYMBOLS),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(words),
        gone(UPPER),
        gone(LOWER),
    )


def with_measures(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """df plus MEASURES and failed_bits: bit b is set where the rule of bit b fails. One pass over the texts, no shuffle."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            got = [measure(x) for x in raw_texts(b, text)]
            cols = list(zip(*got, strict=True)) if got else [[] for _ in MEASURES]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, pa.int64()) for c in cols)], names=[*b.schema.names, *MEASURES])

    arrow_rows(df.sparkSession)
    fields = [f"`{n}` {t}" for n, t in df.dtypes] + [f"{m} long" for m in MEASURES]
    bits = F.lit(0).cast("long")
    for r in rules:
        bits = bits.bitwiseOR(F.when(r.fails(), F.lit(1 << r.bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return df.mapInArrow(run, ", ".join(fields)).withColumn("failed_bits", bits)


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, MEASURES, failed_bits) of every document."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return with_measures(rows, rules).drop("text")


def fails(mask: int) -> Column:
    return F.col("failed_bits").bitwiseAND(F.lit(mask).cast("long")) != 0


def apply_policy(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The ledger with ``kept`` under a policy."""
    return rows.withColumn("kept", ~fails(POLICIES[policy]))


def ablation(rows: DataFrame, policy: str = CURRENT, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each rule of a policy: documents that fail it, that only it rejects, and that are kept without it.

    One aggregation of bits; the texts aren't read again. The ledger is reduced to a count
    for each value of the mask first, of which there are 2 to the number of rules at most.
    """
    mask = POLICIES[policy]
    counts = rows.groupBy(F.col("failed_bits").bitwiseAND(F.lit(mask).cast("long")).alias("failed_bits")).agg(F.count("*").alias("n"))
    rule = F.explode(F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in rules if mask >> r.bit & 1)))
    hit = F.col("failed_bits").bitwiseAND(F.col("bit")) != 0
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n")).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"))
    return (
        counts.select("*", rule.alias("r")).select("failed_bits", "n", "r.rule", "r.bit").groupBy("rule").agg(
            total(hit).alias("n_failed"),
            total(F.col("failed_bits") == F.col("bit")).alias("n_only"),
            total(F.col("failed_bits").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0).alias("n_kept_without"),
        )
    )


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Base measurements, failure bits and the verdict of the current policy for every document."""
    rows = apply_policy(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", fails(BASE).alias("base_failed"),
        (F.col("kept") & ~fails(BASE)).alias("kept"), "failed_bits", "n_lines", "n_upper", "n_lower",
    )
