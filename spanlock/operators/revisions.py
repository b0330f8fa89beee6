"""How predictions are revised while a text arrives, and when gold entities are first found."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .policies import KEY


def raw_revisions(updates: DataFrame) -> DataFrame:
    """Per stream: score events, rescores, distinct spans, and the exact distribution of changes in size."""
    change = F.abs("top_probability_delta")
    return updates.groupBy("example_id").agg(
        F.count(F.lit(1)).alias("updates"),
        F.count_if(F.col("update_kind") == "rescore").alias("rescores"),
        F.countDistinct("start_word", "end_word").alias("spans"),
        F.avg(change).alias("mean_change"),
        F.percentile(change, F.lit(0.5)).alias("median_change"),
        F.max(change).alias("max_change"),
    )


def boundary_extensions(snapshots: DataFrame) -> DataFrame:
    """Entities that reach further than any earlier one with the same start and label; ``was`` is the reach before."""
    family = Window.partitionBy("example_id", "start_word", "label").orderBy("step")
    best = snapshots.groupBy("example_id", "start_word", "label", "step").agg(F.max("end_word").alias("end_word"))
    rows = best.withColumn("was", F.max("end_word").over(family.rowsBetween(Window.unboundedPreceding, -1)))
    return rows.where("end_word > was").select(*KEY, "step", "was")


def boundary_revisions(snapshots: DataFrame) -> DataFrame:
    """Per stream: families (start, label) in two adjacent snapshots, and those whose favoured end moved.

    The favoured end is that of the best score, the longest among equals.
    """
    favoured = snapshots.groupBy("example_id", "start_word", "label", "step").agg(F.max_by("end_word", F.struct("score", "end_word")).alias("end_word"))
    family = Window.partitionBy("example_id", "start_word", "label").orderBy("step")
    rows = favoured.withColumn("before", F.lag("step").over(family)).withColumn("was", F.lag("end_word").over(family)).where("before = step - 1")
    return rows.groupBy("example_id").agg(F.count(F.lit(1)).alias("compared"), F.count_if(F.col("was") != F.col("end_word")).alias("moved"))


def first_detections(gold: DataFrame, snapshots: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(key, detection_step): the first snapshot with exactly the gold entity at a score of at least the threshold."""
    return gold.select(*KEY).distinct().join(first_seen(snapshots, threshold), KEY)


def first_seen(snapshots: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(key, detection_step): the first snapshot with an entity at a score of at least the threshold."""
    return snapshots.where(F.col("score") >= threshold).groupBy(*KEY).agg(F.min("step").alias("detection_step"))


def split_delays(delays: DataFrame, detections: DataFrame) -> DataFrame:
    """Adds the delay of the model (visible to found) and of the policy (found to committed, maybe negative); null if never found.

    The step at which an entity was visible is its commit step less its delay, so gold is not worked out once more.
    """
    rows, visible = delays.join(detections, KEY, "left"), F.col("commit_step") - F.col("update_delay")
    return rows.select(*delays.columns, (F.col("detection_step") - visible).alias("model_delay"), (F.col("commit_step") - F.col("detection_step")).alias("policy_delay"))


def last_snapshot(snapshots: DataFrame, steps: DataFrame) -> DataFrame:
    """Silver references: the entities of each stream's last snapshot."""
    last = steps.groupBy("example_id").agg(F.max("step").alias("step"))
    return snapshots.join(last, ["example_id", "step"]).select(*KEY)


def state_differences(actual: DataFrame, expected: DataFrame, *, rel_tol: float = 1e-6, abs_tol: float = 1e-6) -> DataFrame:
    """(example_id, start_word, end_word, difference): missing or unexpected spans, other widths, and values that are not close."""
    span = ["example_id", "start_word", "end_word"]
    rows = actual.select(*span, F.col("probs").alias("a")).join(expected.select(*span, F.col("probs").alias("e")), span, "full")
    far = F.exists(F.arrays_zip("a", "e"), lambda z: ~(F.abs(z["a"] - z["e"]) <= F.greatest(F.lit(abs_tol), F.greatest(F.abs(z["a"]), F.abs(z["e"])) * rel_tol)))
    kind = F.when(F.col("a").isNull(), "missing").when(F.col("e").isNull(), "unexpected").when(F.size("a") != F.size("e"), "width").when(far, "value")
    return rows.select(*span, kind.alias("difference")).where("difference is not null")


def hashed_horizons(horizons: DataFrame) -> DataFrame:
    """Horizons for publication: streams are named by a digest, texts by nothing."""
    return horizons.select(F.sha2(F.col("example_id").cast("string"), 256).alias("example_sha256"), "start_word", "end_word", "horizon_words")
