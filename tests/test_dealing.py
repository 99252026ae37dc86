"""What searches send through shuffles: texts once and as they are, in partitions that don't grow with the corpus; no text to meet hits."""

from pyspark.sql import functions as F

from lodestone.llm.common import setting
from lodestone.operators import blocks, lexicon
from lodestone.plans import queries


def test_texts_are_cut_after_the_shuffle(spark):
    rows = spark.createDataFrame([("", "s", 0, i, f"word{i} two") for i in range(9)], "index string, source string, block long, id long, text string")
    plan = blocks.packed(rows, 9)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("regexp_extract_all") < plan.index("Repartition")  # the cutting stands above it
    assert blocks.packed(rows, 9).where("term = 'two'").first()["places"] == list(range(9))


def test_partitions_follow_the_documents(spark):
    rows = spark.range(100).select(F.lit(1).alias("_g"), "id")
    assert blocks.dealt(rows, 100).rdd.getNumPartitions() == 1
    assert blocks.dealt(rows, blocks.TOGETHER * blocks.GROUPS * 50).rdd.getNumPartitions() == 50


def test_documents_stay_where_hits_meet_them(spark, tiny):
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        plan = queries.fallback_answer(spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_postings_are_dealt_in_small_splits(spark, tmp_path, monkeypatch):
    """While an index is written, files are read in small splits; the session's setting is as before afterwards."""
    name, seen = "spark.sql.files.maxPartitionBytes", []
    before = spark.conf.get(name)
    held = lexicon.Lexicon(spark, f"file://{tmp_path}/index")
    put = held.table.put
    monkeypatch.setattr(held.table, "put", lambda *a, **k: (seen.append(spark.conf.get(name)), put(*a, **k))[1])
    held.add(spark.createDataFrame([(1, "one two", "s")], "id long, text string, source string"))
    assert seen == ["8m"] and spark.conf.get(name) == before
