"""Readers of corpus files, domain packs, author index, evaluation files."""

from __future__ import annotations

import csv
import json
from collections.abc import Iterator
from itertools import chain, count, islice

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from lodestone.functions import text as T
from lodestone.settings import Settings

GLOB = "*.{[tT][xX][tT],[cC][sS][vV],[jJ][sS][oO][nN]}"


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """(path, source, source_type, domain, timestamp, text): every corpus file below a folder, whole. The domain is the folder that a file is in, null at the root."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", GLOB).text(folder, wholetext=True)
    return described(rows, folder)


def scan_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The same rows for files as they arrive."""
    rows = spark.readStream.option("recursiveFileLookup", True).option("pathGlobFilter", GLOB).option("wholetext", True).format("text").schema("value string").load(folder)
    return described(rows, folder)


def described(rows: DataFrame, folder: str) -> DataFrame:
    parent = F.lower(F.element_at(F.split("path", "/"), -2))
    root = folder.rstrip("/").rsplit("/", 1)[-1].lower()
    held = rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("source"), F.col("_metadata.file_modification_time").cast("double").alias("timestamp"), F.col("value").alias("raw"))
    depth = len([x for x in folder.split("://")[-1].split("/") if x])
    here = F.size(F.filter(F.split(F.regexp_replace("path", "^[a-z]+:/+", ""), "/"), lambda x: x != ""))
    return held.withColumns({
        "source_type": F.lower(F.element_at(F.split("source", r"\."), -1)),
        "domain": F.when((parent == root) & (here <= depth + 1), F.lit(None)).otherwise(parent),
    }).withColumn("text", flattened(F.col("raw"), F.col("source_type"))).drop("raw")


def json_lines(value, most: int, prefix: str = "") -> list[str]:
    """``a.b.0: v`` for each leaf, depth first, in the order of the file."""
    out: list[str] = []
    todo = [(prefix, value)]
    while todo and len(out) < most:
        at, v = todo.pop()
        if isinstance(v, (dict, list)):
            inner = v.items() if isinstance(v, dict) else enumerate(v)
            todo += reversed([(f"{at}.{k}" if at else str(k), x) for k, x in inner])
        else:
            out.append(f"{at}: {v}")
    return out


def csv_lines(text: str, most: int) -> list[str]:
    """``header: cell`` joined for each row behind the first; cells without a header are named by their place."""
    rows = csv.reader(text.splitlines())
    head = next(rows, [])
    named = lambda row: zip(chain(head, map("col_{}".format, count(len(head)))), row)
    return [" | ".join(map(": ".join, named(row))) for row in islice(rows, most)]


def flatten(text: str | None, kind: str | None, most: int = Settings.flatten_lines) -> str | None:
    """A JSON or CSV text as lines; itself if it isn't what its name says."""
    try:
        if kind == "json":
            return "\n".join(json_lines(json.loads(text), most))
        if kind == "csv":
            return "\n".join(csv_lines(text, most))
    except (ValueError, TypeError, csv.Error, RecursionError):
        pass
    return text


def flattened(text: Column, kind: Column, most: int = Settings.flatten_lines) -> Column:
    """flatten over Arrow batches: the order and spelling of values are those of the file, which built-in parsers don't keep. Plain text passes by."""
    import pandas as pd

    def run(texts: pd.Series, kinds: pd.Series) -> pd.Series:
        return pd.Series([flatten(t, k, most) for t, k in zip(texts, kinds, strict=True)], dtype=object)

    run.__annotations__ = {"texts": pd.Series, "kinds": pd.Series, "return": pd.Series}
    return F.when(kind.isin("json", "csv"), F.pandas_udf(run, "string")(text, kind)).otherwise(text)


PACK = S.StructType([
    S.StructField("name", S.StringType()),
    S.StructField("description", S.StringType()),
    *(S.StructField(k, S.ArrayType(S.StringType())) for k in ("authors", "author_stopwords", "query_stopwords")),
    S.StructField("term_synonyms", S.MapType(S.StringType(), S.ArrayType(S.StringType()))),
    S.StructField("planner_hints", S.ArrayType(S.StructType([
        S.StructField("triggers", S.ArrayType(S.StringType())), S.StructField("intent", S.StringType()),
        S.StructField("hypotheses", S.ArrayType(S.StringType())), S.StructField("queries", S.ArrayType(S.StringType())),
    ]))),
])


def packs(spark: SparkSession, folder: str) -> list[dict]:
    """Domain packs in the order of their file names; reading ends at the first that isn't valid. They are few and small. A missing folder has none."""
    try:
        rows = spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("f"), F.from_json("value", PACK).alias("p"), F.try_parse_json("value").isNull().alias("bad"))
        found = rows.orderBy("f").collect()
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return []
    out = []
    for r in found:
        if r["bad"]:
            break
        out.append(r["p"].asDict(recursive=True))
    return out


def pack_set(found: list[dict], key: str) -> list[str]:
    return sorted({x.lower() for p in found for x in p.get(key) or []})


def synonyms(found: list[dict], extra: dict[str, list[str]] | None = None) -> dict[str, list[str]]:
    """Terms of all packs, each once; those of the settings behind them."""
    out: dict[str, list[str]] = {}
    for p in found:
        for k, v in (p.get("term_synonyms") or {}).items():
            out[k.lower()] = list(dict.fromkeys([*out.get(k.lower(), []), *(x.lower() for x in v or [])]))
    for k, v in (extra or {}).items():
        out.setdefault(k.lower(), []).extend(x.lower() for x in v)
    return out


def planner_rules(found: list[dict]) -> list[dict]:
    return [h for p in found for h in p.get("planner_hints") or [] if h.get("triggers")]


def author_index(spark: SparkSession, path: str) -> DataFrame:
    """(term, source) of an index file {term: [source, …]}."""
    held = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    return held.select(F.explode("m").alias("term", "sources")).select(F.lower("term").alias("term"), F.explode("sources").alias("source"))


def author_terms(chunks: DataFrame, keywords: dict[str, list[str]]) -> DataFrame:
    """(term, sources) of sources whose name contains a keyword of any domain."""
    words = sorted({w.lower() for v in keywords.values() for w in v})
    low = F.lower("source")
    hit = F.filter(T.literals(words), lambda w: F.contains(low, w))
    return chunks.select("source").distinct().select("source", F.explode(hit).alias("term")).groupBy("term").agg(F.array_sort(F.collect_set("source")).alias("sources"))


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """(query, expected_sources, reference_answer); the last line of a query counts, lines without one go."""
    row = F.from_json("value", "query string, expected_sources array<string>, reference_answer string")
    held = spark.read.text(path).where(T.strip(F.col("value")) != "").select(row.alias("r"), F.monotonically_increasing_id().alias("n")).where("r.query IS NOT NULL AND r.query <> ''")
    last = held.groupBy(F.col("r.query").alias("query")).agg(F.max_by("r", "n").alias("r"))
    return last.select("query", F.coalesce("r.expected_sources", F.array().cast("array<string>")).alias("expected_sources"), F.coalesce("r.reference_answer", F.lit("")).alias("reference_answer"))


RESULT = "base_url string, query string, answer string, sources array<string>, confidence double, error string"


def results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RESULT).json(path).where("query IS NOT NULL")


def questions(spark: SparkSession, path: str) -> DataFrame:
    """(query): a line's JSON query if it is such a line, else the line."""
    value = T.strip(F.col("value"))
    found = F.when(F.startswith(value, F.lit("{")), F.get_json_object(F.when(F.try_parse_json(value).isNotNull(), value), "$.query"))
    return spark.read.text(path).where(value != "").select(F.coalesce(found, value).alias("query"))
