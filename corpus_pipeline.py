"""From raw documents to packed sequences, in five stages.

Each stage takes what its predecessor kept as a written table. All but the last return the
columns of documents; the last returns the pieces and their places in sequences.

Defined cases, of every stage: an empty table gives one. Rows that are repeated, or share an id,
are judged by their own texts and keep a row each; near duplicates of the same id go or stay
together. A null text counts as empty: it is not toxic, fails the rules, is no duplicate, has no
personal data and packs as the end id alone. Rows with a null id are never dropped as
duplicates. Texts are taken whole, however long. Other columns are dropped, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import neardup, packing, pii, quality, toxicity
from lodestone.llm.common import keep

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Of 100 shingles of five words, how many near duplicates share at least.
NEAR = 80


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the field's score rejects. The field is fitted on the labelled documents among docs."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.with_score(docs.select(*COLUMNS), model).where(F.col("score") < toxicity.THRESHOLD).select(*COLUMNS)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the current policy rejects."""
    return quality.with_measures(docs.select(*COLUMNS)).where(~quality.fails(quality.POLICIES[quality.CURRENT])).select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of near duplicates, every document without shingles, and rows without an id. Rows that share an id stay together."""
    kept = neardup.near_duplicates(docs, NEAR).where("kept").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").union(docs.where("doc_id IS NULL")).select(*COLUMNS)


def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the kind in place of each span of personal data."""
    return pii.redact(pii.with_spans(docs.select(*COLUMNS))).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs everything that is left into sequences."""
    return packing.pack(keep(packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json")), "pieces"))


STAGES = [("toxicity", toxic), ("quality rules", rules), ("near duplicates", near), ("personal data", personal), ("packing", packed)]

#: The field of the first stage and the last stage's tokens are beyond SQL; tests compare them with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        docs = keep(made, f"stage-{k}", [docs]) if k + 1 < len(STAGES) else made
    return docs
