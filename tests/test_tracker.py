"""The online tracker against the batch code, prefix by prefix."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from spanlock.operators import policies as P
from spanlock.operators import resolve as R
from spanlock.operators import specs as G
from spanlock.operators import updates as U
from spanlock.plans import evaluations as E
from spanlock.sources import tables
from spanlock.streaming import tracker as T

TEXTS = [(1, "Ann Lee met Bob in Rome, and then Bob left for Oslo with Ann."), (2, "A b c d e f g."), (3, "one")]


@pytest.fixture(scope="module")
def log(spark):
    how = U.Scoring(right_context=4)
    texts = spark.createDataFrame(TEXTS, "id long, text string")
    steps = U.with_word_counts(tables.chunk_conditions(texts, [2])).withColumn("example_id", F.substring_index("example_id", ":", -1).cast("long")).cache()
    return steps, U.observations(U.span_updates(U.hash_scorer(U.candidates(steps, how), how), how), how).cache()


STATES = [*P.KEY, "step", "probability", "rescore_count", "snapshot_age", "tail_distance_words"]
READY = ["policy_id", *P.KEY, "step", "probability", "readiness"]


def batch(log, through):
    """(states, ready, commits) that the batch code finds in the log up to a step."""
    steps, obs = (df.where(F.col("step") <= through) for df in log)
    obs = obs.withColumn("next_step", F.when(F.col("next_step") <= through, F.col("next_step")))
    states = U.candidate_states(obs, steps)
    ready = P.first_ready(G.ready(states, E.TRACKED), ("policy_id",))
    return states.select(*STATES), ready.select(*READY), R.commits(ready, policy=("policy_id",))


def test_every_prefix_equals_the_batch_over_many_batches_and_restarts(spark, log, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("events", "out", "checkpoint"))
    last = log[0].agg(F.max("step")).first()[0]
    assert last >= 7
    for step in range(1, last + 1):  # each run is a new query that goes on from the state of the one before
        T.events(*log).where(F.col("step") == step).coalesce(1).write.mode("append").parquet(source)
        rows = T.run_available(spark, source, out, checkpoint, E.TRACKED).cache()
        for kind, want in zip(("state", "ready", "commit"), batch(log, step)):
            got = rows.where(F.col("kind") == kind).select(*want.columns)
            assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty(), (kind, step)
            assert not want.isEmpty()
        rows.unpersist()
    assert rows.where("kind = 'late'").isEmpty()


def test_one_batch_of_all_steps_is_the_same(spark, log, tmp_path):
    T.events(*log).write.parquet(str(tmp_path / "events"))
    rows = T.run_available(spark, str(tmp_path / "events"), str(tmp_path / "out"), str(tmp_path / "checkpoint"), E.TRACKED, states=False)
    _, ready, commits = batch(log, 1000)
    for kind, want in (("ready", ready), ("commit", commits)):
        got = rows.where(F.col("kind") == kind).select(*want.columns)
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert rows.where("kind = 'state'").isEmpty()


def test_late_rows_and_strict(spark, tmp_path):
    source, spec = str(tmp_path / "events"), [G.Spec("fixed-threshold", "main", (("threshold", 0.5),))]
    run = lambda name, **o: T.run_available(spark, source, str(tmp_path / name), str(tmp_path / f"c{name}"), spec, **o)
    spark.createDataFrame([(1, 2, 4, None, None, None, None, None), (1, 2, 4, 0, 0, "a", 0.9, 0.1)], T.EVENT).coalesce(1).write.mode("append").parquet(source)
    run("x"), run("y", strict=True)
    spark.createDataFrame([(1, 1, 2, 1, 1, "a", 0.9, 0.1)], T.EVENT).coalesce(1).write.mode("append").parquet(source)
    assert {(r["kind"], r["start_word"], r["step"]) for r in run("x").collect()} == {("state", 0, 2), ("ready", 0, 2), ("commit", 0, 2), ("late", 1, 1)}
    with pytest.raises(Exception, match="came after step 2"):
        run("y", strict=True)


def test_a_policy_that_looks_ahead_is_refused(spark):
    with pytest.raises(ValueError, match="look ahead"):
        T.track(spark.createDataFrame([], T.EVENT), [s for s in G.expand() if s.analysis_only])
