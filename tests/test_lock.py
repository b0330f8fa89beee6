"""Locked selections and axes that follow the scores."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from spanlock.operators import specs as G
from spanlock.sources import lock as H
from spanlock.sources import runs as N

SPECS = [G.Spec("fixed-threshold", "main", (("threshold", t),)) for t in (0.5, 0.9)]


def parts(spark):
    records = spark.createDataFrame([(s.policy_id, "4", 10 + i) for i, s in enumerate(SPECS)], "policy_id string, chunk_words string, commits long")
    winners = spark.createDataFrame([("fixed-threshold", "quality", SPECS[1].policy_id)], "selection_key string, mode string, policy_id string")
    return winners, records, G.frame(spark, SPECS), {"reference": SPECS[0].policy_id}


def test_a_lock_opens_as_long_as_its_inputs_are_the_same(spark, tmp_path):
    winners, records, competed, rule = parts(spark)
    folder = H.freeze(spark, str(tmp_path), winners, records, competed, rule, split="dev")
    assert H.freeze(spark, str(tmp_path), winners, records.orderBy("commits", ascending=False), competed, rule, split="dev") == folder
    rows, specs = H.opened(spark, folder, records, competed, rule, split="dev")
    assert specs == [SPECS[1]] and [r["mode"] for r in rows.collect()] == ["quality"]


def test_any_changed_input_is_refused(spark, tmp_path):
    winners, records, competed, rule = parts(spark)
    folder = H.freeze(spark, str(tmp_path), winners, records, competed, rule, split="dev")
    changed = [(records.withColumn("commits", F.col("commits") + 1), competed, rule, "dev"), (records.unionByName(records), competed, rule, "dev"), (records, competed.limit(1), rule, "dev"), (records, competed, {"reference": "x"}, "dev"), (records, competed, rule, "test")]
    for r, c, q, split in changed:
        with pytest.raises(N.IntegrityError, match="not the run"):
            H.opened(spark, folder, r, c, q, split=split)


def test_a_winner_that_was_changed_is_refused(spark, tmp_path):
    winners, records, competed, rule = parts(spark)
    folder = H.freeze(spark, str(tmp_path), winners, records, competed, rule, split="dev")
    stored = spark.read.parquet(f"{folder}/winners").collect()
    spark.createDataFrame(stored, spark.read.parquet(f"{folder}/winners").schema).withColumn("parameters_json", F.lit('{"threshold":0.1}')).coalesce(1).write.mode("overwrite").parquet(f"{folder}/winners")
    with pytest.raises(N.IntegrityError, match="digest"):
        H.opened(spark, folder, records, competed, rule, split="dev")
    with pytest.raises(ValueError, match="not the id"):
        G.from_row({**stored[0].asDict(), "parameters_json": '{"threshold":0.1}'})


def test_axes_keep_the_thresholds_that_part_scores(spark):
    obs = spark.createDataFrame([(0.12,), (0.13,), (0.5,), (0.97,)], "probability double")
    axes = G.observed_axes(obs)
    assert axes["fixed-threshold"]["threshold"] == [0.1, 0.5, 0.95] == axes["ema"]["threshold"]
    assert axes["oracle-stable"] == G.AXES["oracle-stable"] and axes["stability-gate"] == G.AXES["stability-gate"]
