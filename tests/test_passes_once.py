"""Queries that work each side of a comparison out once."""

from __future__ import annotations

from spanlock.operators import metrics as M
from spanlock.operators.policies import KEY
from spanlock.plans import queries as Q


def test_outcomes_score_the_log_and_read_the_gold_once(spark, sf_dir):
    plan = Q.QUERIES["outcomes"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == 3  # one for each label, and gold


def test_outcomes_count_rows_that_are_there_twice(spark):
    rows = lambda *spans: spark.createDataFrame(spans, ", ".join(f"{c} {'string' if c == 'label' else 'long'}" for c in KEY))
    out = M.outcomes(rows((1, 0, 1, "a"), (1, 0, 1, "a"), (1, 3, 3, "a"), (2, 0, 0, "a")), rows((1, 0, 1, "a"), (1, 5, 5, "a"), (1, 5, 5, "a"), (3, 1, 1, "b")))
    assert {tuple(r) for r in out.collect()} == {(1, 3, 2, 1, 3, 2), (2, 1, 0, 1, 0, 0), (3, 0, 0, 0, 1, 1)}
