"""Commitment policies: when a candidate of a stream is ready.

Readiness depends on a candidate's own past alone, so the first step at which a policy is
ready is a filter and a minimum over ``candidate_states``, for all candidates at once. Where
readiness changes only with a new score (``fixed_threshold``, ``rescore_patience``, ``ema``) the
far fewer score events give the same first step: these take ``observations`` too.
Comparison is always probability >= threshold.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["example_id", "start_word", "end_word", "label"]


def _ready(rows: DataFrame, score: str = "probability") -> DataFrame:
    return rows.select(*KEY, "step", "probability", F.col(score).alias("readiness"))


def fixed_threshold(states: DataFrame, threshold: float) -> DataFrame:
    return _ready(states.where(F.col("probability") >= threshold))


def fixed_lag(states: DataFrame, threshold: float, lag_words: int) -> DataFrame:
    """The tail counts words now visible, so cached candidates age into readiness."""
    return _ready(states.where((F.col("probability") >= threshold) & (F.col("tail_distance_words") >= lag_words)))


def snapshot_patience(states: DataFrame, threshold: float, patience: int) -> DataFrame:
    """At least ``patience`` consecutive snapshots at the threshold; cached ones count."""
    key = Window.partitionBy(*KEY).orderBy("step")
    rows = states.withColumn("low", (F.col("probability") < threshold).cast("int")).withColumn("run", F.sum("low").over(key))
    inside = Window.partitionBy(*KEY, "run").orderBy("step")
    rows = rows.where("low = 0").withColumn("held", F.row_number().over(inside))
    return _ready(rows.where(F.col("held") >= patience))


def rescore_patience(states: DataFrame, threshold: float, patience: int) -> DataFrame:
    """At the threshold with at least ``patience`` real scores, the first included."""
    return _ready(states.where((F.col("probability") >= threshold) & (F.col("rescore_count") >= patience)))


def ema(states: DataFrame, threshold: float, alpha: float) -> DataFrame:
    """Exponential average over real scores; cached steps keep it. One fold over a candidate's rows in order."""
    scored = F.col("was_rescored") if "was_rescored" in states.columns else F.lit(True)
    rows = states.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("step", "probability", scored.alias("scored")))).alias("rows"))
    begin = F.array(F.struct(F.col("rows")[0]["step"].alias("step"), F.col("rows")[0]["probability"].alias("probability"), F.col("rows")[0]["probability"].alias("ema")))

    def add(kept: Column, r: Column) -> Column:
        before = F.element_at(kept, -1)["ema"]
        now = F.when(r["scored"], r["probability"] * alpha + before * (1 - alpha)).otherwise(before)
        return F.array_append(kept, F.struct(r["step"].alias("step"), r["probability"].alias("probability"), now.alias("ema")))

    averages = rows.select(*KEY, F.explode(F.aggregate(F.slice("rows", 2, 1 << 30), begin, add)).alias("r")).select(*KEY, "r.*")
    return _ready(averages.where(F.col("ema") >= threshold), "ema")


def first_ema(states: DataFrame, threshold: float, alpha: float) -> DataFrame:
    """The first ready row of ``ema`` for each candidate, by a fold that keeps the average and that row alone."""
    scored = F.col("was_rescored") if "was_rescored" in states.columns else F.lit(True)
    rows = states.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("step", "probability", scored.alias("scored")))).alias("rows"))
    step = states.schema["step"].dataType.simpleString()
    begin = F.struct(F.lit(None).cast("double").alias("ema"), F.lit(None).cast(f"struct<step:{step},probability:double,readiness:double>").alias("at"))

    def add(kept: Column, r: Column) -> Column:
        before = kept["ema"]
        now = F.when(before.isNull(), r["probability"]).when(r["scored"], r["probability"] * alpha + before * (1 - alpha)).otherwise(before)
        ready = F.when(now >= threshold, F.struct(r["step"].alias("step"), r["probability"].alias("probability"), now.alias("readiness")))
        return F.struct(now.alias("ema"), F.coalesce(kept["at"], ready).alias("at"))

    found = rows.select(*KEY, F.aggregate("rows", begin, add, lambda kept: kept["at"]).alias("at"))
    return found.where("at is not null").select(*KEY, "at.*")


def gate_features(states: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Features of the stability gate: instability, margin of the span's two best labels, advantage of longer spans.

    The first two belong to the last score and are carried with it; only the third looks at other spans.
    """
    family = Window.partitionBy("example_id", "step", "start_word", "label").orderBy(F.desc("end_word")).rowsBetween(Window.unboundedPreceding, -1)  # a running maximum
    rows = states.withColumn("longer", F.max("probability").over(family))
    return rows.select(*KEY, "step", "probability", "rescore_count", "tail_distance_words", "instability", "label_margin", F.coalesce(F.col("longer") - F.col("probability"), F.lit(0.0)).alias("extension_advantage"), *keep)


def stability_gate(features: DataFrame, threshold: float, *, min_rescores: int = 1, epsilon: float | None = None, min_margin: float | None = None, max_extension: float | None = None, min_tail: int | None = None) -> DataFrame:
    """All gates must pass; a gate that is None is switched off (ablation)."""
    ok = (F.col("probability") >= threshold) & (F.col("rescore_count") >= min_rescores)
    if epsilon is not None:
        ok &= F.col("instability") <= epsilon
    if min_margin is not None:
        ok &= F.col("label_margin") >= min_margin
    if max_extension is not None:
        ok &= F.col("extension_advantage") <= max_extension
    if min_tail is not None:
        ok &= F.col("tail_distance_words") >= min_tail
    return _ready(features.where(ok))


def oracle_stable(states: DataFrame, threshold: float, *, look_ahead: bool = False) -> DataFrame:
    """Looks ahead: ready from the first step after which the candidate never falls below. For analysis only, so the caller must allow it."""
    allow_look_ahead(["oracle_stable"], look_ahead)
    key = Window.partitionBy(*KEY)
    low = F.max(F.when(F.col("probability") < threshold, F.col("step"))).over(key)
    return _ready(states.withColumn("low", low).where("low is null or step > low"))


def allow_look_ahead(names: list[str], allowed: bool) -> None:
    """An error if policies that know later scores are named and the caller did not allow them."""
    if names and not allowed:
        raise ValueError(f"policies that look ahead are for analysis only (look_ahead=True): {names}")


def first_ready(ready: DataFrame, policy: tuple[str, ...] = ()) -> DataFrame:
    """A candidate's first ready row; later ones cannot commit it (see ``resolve``). ``policy`` names columns that tell policies apart."""
    first = [F.min_by(c, "step").alias(c) for c in ("probability", "readiness")]  # plain numbers, which a hash aggregate can keep
    return ready.groupBy(*policy, *KEY).agg(F.min("step").alias("step"), *first)


def grid(rows: DataFrame, policies: dict[str, Column]) -> DataFrame:
    """Ready rows of many policies in one pass: each row is repeated for the policies whose condition it meets."""
    met = F.array(*(F.when(condition, F.lit(name)) for name, condition in policies.items()))
    rows = rows.select(*KEY, "step", "probability", F.explode(F.filter(met, lambda m: m.isNotNull())).alias("policy_id"))
    return rows.withColumn("readiness", F.col("probability"))


def first_of_grid(rows: DataFrame, policies: dict[str, Column]) -> DataFrame:
    """First ready rows of many policies, with ``policy``, the place of a policy among them: one aggregate a candidate, and not one for each of its policies."""
    at = [F.when(condition, F.col("step")) for condition in policies.values()]
    firsts = [c for i, step in enumerate(at) for c in (F.min(step).alias(f"__step{i}"), F.min_by("probability", step).alias(f"__p{i}"))]
    found = rows.where(reduce(or_, policies.values())).groupBy(*KEY).agg(*firsts)
    met = F.array(*(F.when(F.col(f"__step{i}").isNotNull(), F.struct(F.lit(i).alias("policy"), F.col(f"__step{i}").alias("step"), F.col(f"__p{i}").alias("probability"))) for i in range(len(at))))
    return found.select(*KEY, F.explode(F.filter(met, lambda m: m.isNotNull())).alias("m")).select("m.policy", *KEY, "m.step", "m.probability", F.col("m.probability").alias("readiness"))


def gate_ablations(threshold: float, epsilon: float, min_margin: float, max_extension: float, min_tail: int) -> dict[str, Column]:
    """The stability gate, the gate without each of its three features, and with a least tail distance: conditions for ``grid``."""
    base = F.col("probability") >= threshold
    gates = {"instability": F.col("instability") <= epsilon, "label_margin": F.col("label_margin") >= min_margin, "extension": F.col("extension_advantage") <= max_extension}

    def without(left_out: str | None) -> Column:
        ok = base
        for name, gate in gates.items():
            ok = ok if name == left_out else ok & gate
        return ok

    out = {"full": without(None)} | {f"minus_{name}": without(name) for name in gates}
    return out | {"plus_tail_distance": without(None) & (F.col("tail_distance_words") >= min_tail)}
