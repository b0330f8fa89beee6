"""Steps that were mended for large tables: draws that are never broadcast, tasks that grow in number and not in size."""

from __future__ import annotations

import pytest

from spanlock.operators import resampling as B
from spanlock.operators import selection as S
from spanlock.plans import evaluations  # noqa: F401
from spanlock.plans import queries as Q
from spanlock.sources import tables
from spanlock.streaming import tracker as T


def final_plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def sums(spark):
    return spark.createDataFrame([(p % 4, p, "a", float(p % 3), 2.0) for p in range(40)], "task int, parent long, policy string, num double, den double")


def test_draws_of_one_comparison_are_not_broadcast(spark):
    plan = final_plan(S.paired_bootstrap(sums(spark), "task", "parent", ("num", "den"), ("den", "num"), replicates=50))
    assert "ShuffledHashJoin" in plan and "BroadcastHashJoin" not in plan


def test_draws_of_many_comparisons_meet_the_sums_in_one_join_without_broadcast(spark):
    metrics = {"rate": ("num", "den")}
    plan = final_plan(B.bootstrap_rows(sums(spark), "task", "parent", ["policy"], [B.Comparison(("x",), ("a",), ("b",))], metrics, names=["name"], replicates=50))
    assert plan.count("Join") == 1 and "ShuffledHashJoin" in plan


def test_partitions_grow_with_the_source_and_tasks_do_not(spark, monkeypatch):
    monkeypatch.setattr(tables, "TURNS_PER_TASK", 5)
    monkeypatch.setattr(tables, "TEXTS_PER_TASK", 5)
    turns = spark.range(60).selectExpr("id % 30 conv_id", "cast(id div 30 as int) turn", "'user' role", "'a b c' text")
    assert tables.conversation_steps(turns).rdd.getNumPartitions() == 12
    texts = spark.range(100).selectExpr("id", "'a b c' text")
    assert tables.chunk_conditions(texts, [1, 2]).rdd.getNumPartitions() == 20


def test_parities_of_entities_decode_the_snapshots_once(spark, sf_dir):
    plan = Q.QUERIES["parity_entities"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan  # the comparison reads what was written


def test_stability_and_buffer_read_the_log_once(spark, sf_dir):
    for name in ("trajectory_stability", "commits_edge_buffer"):
        plan = Q.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("md5(") == 2, name  # one score for each label


def test_states_of_a_stream_come_as_columns():
    tracker = T._Tracker([], None)
    tracker.observe(1, [(0, 0, "person", 0.5, 0.1), (0, 1, "place", 0.25, 0.2)])
    states = tracker.states(7, 1, 3)
    assert states["start_word"].tolist() == [0, 0] and states["tail_distance_words"].tolist() == [2, 1] and states["snapshot_age"].tolist() == [0, 0]
    assert list(tracker.rows(7, 1, 3)) == []
