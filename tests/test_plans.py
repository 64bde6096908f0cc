"""Plans that must hold at scale."""

import re

import pytest

from undulo.operators import build as B
from undulo.plans.queries import QUERIES, Text
from undulo.sources import text as T


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_what_they_need(spark, sf_dir):
    plan = plan_of(QUERIES["hist_events"](spark, sf_dir))
    assert "ReadSchema: struct<event_id:bigint,event_type:string>" in plan or "ReadSchema: struct<event_type:string" in plan


@pytest.mark.parametrize("name", ["wt_levels_chars", "wt_levels_users", "wt_merge_nodes_users", "dsplit_targets", "dsplit_tree_4", "export_nodes_types"])
def test_no_cartesian_product(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def exchanges(plan):
    """What each exchange of a plan carries: the output of the node below it."""
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)


@pytest.mark.parametrize("kind", [B.TREE, B.MATRIX, B.NODES])
def test_a_build_shuffles_words_only(spark, sf_dir, kind):
    """Chunks, once packed, are read and move nowhere; words are brought together, and the few counts of ranges."""
    t = Text(spark, sf_dir, "chars")
    plan = plan_of(t.build(kind))
    assert plan.count("MapInArrow") == 1
    for keys in exchanges(plan):
        assert "symbols" not in keys and re.match(r"(level|node_id|part|raw)#", keys), keys
    # the join that brings counts to chunks sends the counts
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 1


def test_prefix_reads_whole_chunks_that_it_needs(spark, sf_dir):
    t = Text(spark, sf_dir, "chars")
    plan = plan_of(T.prefix(t.chunks, 100))
    assert plan.index("start") >= 0 and plan.count("MapInArrow") == 1


def test_sides_beyond_the_bound_are_not_broadcast(spark, sf_dir, monkeypatch):
    from undulo.sources import scratch

    monkeypatch.setattr(scratch, "BROADCAST_ROWS", 1)
    plan = plan_of(QUERIES["inverse_transform"](spark, sf_dir))
    assert "SortMergeJoin" in plan
