"""Graph contexts: what goes through a shuffle, and results where entities are too many to be broadcast."""

from lodestone.llm.common import setting
from lodestone.operators import context
from lodestone.plans import queries


def test_each_edge_table_is_shuffled_once_by_its_key(spark, tiny):
    with setting(spark, "spark.sql.adaptive.enabled", "false"):
        plan = queries.graph_context(spark, tiny)._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in plan.splitlines() if "Exchange hashpartitioning(" in x and "Reused" not in x]
    of = lambda *keys: [x for x in dealt if "hashpartitioning(" + ", ".join(keys) in "".join(c for c in x if c not in "#0123456789L")]
    assert sum("BY_NUM" in x for x in of("query_id, name, ")) == 1  # mentions are counted once, for the first ones and for those with relations
    assert not of("chunk_id, name, ") and not of("claim_id, name, ") and not of("src, predicate, dst, ")  # edges are made one where they are joined
    assert len(of("chunk_id, ")) <= 8 and len(of("claim_id, ")) <= 4


def test_without_broadcast(spark, tiny, monkeypatch):
    rows = lambda: sorted(map(repr, queries.graph_context(spark, tiny).collect()))
    want = rows()
    monkeypatch.setattr(context, "FEW", 0)
    assert rows() == want
