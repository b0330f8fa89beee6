"""Tables of a run to whole examples and back, in one exchange."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from spanlock.plans import evaluations as E
from spanlock.plans import queries as Q
from spanlock.sources import examples as X

NAMES = ("examples", "steps", "updates", "gold", "cold")


@pytest.fixture(scope="module")
def stored(spark, sf_dir, tmp_path_factory):
    """The tables of the conversations as files."""
    folder = tmp_path_factory.mktemp("run")
    for name, df in E.run_tables(Q.stream(spark, sf_dir)).items():
        df.write.parquet(f"{folder}/{name}")
    return {name: spark.read.parquet(f"{folder}/{name}") for name in NAMES}


def test_there_and_back_is_the_identity_in_one_exchange(spark, stored):
    nested = X.reconstruct(**stored)
    plan = nested._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    nested = X.sound(nested).cache()
    for name, df in stored.items():
        back = X.rows_of(nested, name).select(df.columns)
        assert back.count() == df.count() and back.exceptAll(df).isEmpty(), name
    assert nested.count() == stored["examples"].count()
    first = nested.first()
    assert [s["step"] for s in first["steps"]] == list(range(1, len(first["steps"]) + 1))


def test_tables_bucketed_by_example_need_no_exchange(spark, stored):
    for name in ("steps", "updates"):
        stored[name].write.bucketBy(4, "example_id").mode("overwrite").saveAsTable(f"bucketed_{name}")
    try:
        steps = spark.table("bucketed_steps")
        plan = X.cogroup({"steps": steps}, {"steps": ["step"]})._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
    finally:
        for name in ("steps", "updates"):
            spark.sql(f"drop table bucketed_{name}")


def test_every_rule_is_found_and_repeated_rows_stay(spark):
    examples = spark.createDataFrame([(1, "ab"), (2, "ab"), (2, "ab"), (3, "x"), (4, "ab"), (5, "ab")], "example_id long, text string")
    steps = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "ab"), (4, 1, "a"), (4, 3, "c"), (5, 1, "ab"), (9, 1, "z")], "example_id long, step long, chunk string")
    updates = spark.createDataFrame([(1, 1, 0, 0), (1, 1, 0, 0), (4, 2, 0, 0)], "example_id long, step long, start_word long, end_word long")
    gold = spark.createDataFrame([(1, 1, 2, "p"), (1, 0, 2, "p")], "example_id long, start_char long, end_char long, label string")
    cold = spark.createDataFrame([(1, "ab"), (2, "ab"), (3, "x"), (4, "other")], "example_id long, full_text string")
    nested = X.reconstruct(examples, steps, updates, gold, cold)
    rows = {r["example_id"]: r for r in nested.collect()}
    assert {k: r["faults"] for k, r in rows.items()} == {1: [], 2: ["repeated_example"], 3: ["no_steps"], 4: ["cold_text", "stream_text", "step_gap", "unknown_step"], 5: ["cold_missing"], 9: ["unknown_example"]}
    assert len(rows[1]["updates"]) == 2 and [g["start_char"] for g in rows[1]["gold"]] == [0, 1]
    assert X.sound(nested.where("example_id = 1")).count() == 1
    with pytest.raises(Exception, match="example 4 breaks cold_text, stream_text"):
        X.sound(nested.where("example_id = 4")).collect()
    assert X.reconstruct(*(df.where(F.lit(False)) for df in (examples, steps, updates, gold, cold))).count() == 0
