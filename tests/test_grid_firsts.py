"""First ready rows of a grid of thresholds: one aggregate a candidate."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlock.operators import policies as P
from spanlock.plans import queries as Q


def test_first_rows_of_a_grid_are_those_of_each_policy(spark, sf_dir):
    obs = Q.stream(spark, sf_dir).obs
    policies = {f"t{t}": F.col("probability") >= t for t in (0.5, 0.8)} | {"late": (F.col("probability") >= 0.3) & (F.col("step") >= 3)}
    name = F.element_at(F.array(*map(F.lit, policies)), F.col("policy") + 1)
    got = P.first_of_grid(obs, policies).withColumn("policy_id", name)
    want = P.first_ready(P.grid(obs, policies), ("policy_id",))
    got = got.select(*want.columns)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and not want.isEmpty()


def test_candidates_are_not_repeated_for_each_policy_before_they_are_aggregated(spark, sf_dir):
    plan = Q.QUERIES["commits_threshold_grid"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Aggregate [example_id"):]
    assert "threshold_0.5" not in below and "policy" not in below.splitlines()[0]
