"""Evaluation of commits against gold: exact match, masking, outcomes, delays, churn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .policies import KEY


def ratio(numerator: Column, denominator: Column) -> Column:
    """0.0 where the denominator is 0."""
    return F.when(denominator != 0, numerator / denominator).otherwise(F.lit(0.0))


def f_beta(p: Column, r: Column, beta: float) -> Column:
    return ratio(p * r * (1 + beta * beta), p * (beta * beta) + r)


def strict_counts(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """Per stream: true and false positives and false negatives of exact (start, end, label); duplicates count once."""
    left = predicted.select(*KEY).distinct().withColumn("p", F.lit(1))
    right = gold.select(*KEY).distinct().withColumn("g", F.lit(1))
    both = left.join(right, KEY, "full")
    n = lambda c: F.count_if(c).alias
    return both.groupBy("example_id").agg(n(F.col("p").isNotNull() & F.col("g").isNotNull())("tp"), n(F.col("g").isNull())("fp"), n(F.col("p").isNull())("fn"))


def merge_intervals(rows: DataFrame, key: list[str], start: str = "start_char", end: str = "end_char") -> DataFrame:
    """The union of half-open intervals; overlapping and adjacent ones merge."""
    order = Window.partitionBy(*key).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = rows.withColumn("opens", (reach.isNull() | (F.col(start) > reach)).cast("int"))
    islands = islands.withColumn("island", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return islands.groupBy(*key, "island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("island")


def side_by_side(marks: DataFrame, rows: DataFrame, position: str) -> DataFrame:
    """Both tables as one, for a window over their common order.

    The marks are dealt out anew: Spark zips the sides of a union that are partitioned alike, and
    that fails when adaptive execution has merged the partitions of one side only.
    """
    return marks.repartition(position).unionByName(rows, allowMissingColumns=True)


def covered_before(points: DataFrame, islands: DataFrame, position: str = "position") -> DataFrame:
    """Adds covered: how much of the disjoint ``islands`` of its stream lies before each point. One window, no pairs.

    Points and islands are put in one order; a point looks back to the last island that begins there or before.
    """
    before = Window.partitionBy("example_id").orderBy("start_char").rowsBetween(Window.unboundedPreceding, -1)
    island = F.struct("start_char", "end_char", F.coalesce(F.sum(F.col("end_char") - F.col("start_char")).over(before), F.lit(0)).alias("sum"))
    marks = islands.select("example_id", F.col("start_char").alias(position), F.lit(0).alias("__kind"), island.alias("__island"))
    rows = side_by_side(marks, points.withColumn("__kind", F.lit(1)), position)
    order = Window.partitionBy("example_id").orderBy(position, "__kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("__last", F.last("__island", ignorenulls=True).over(order)).where("__kind = 1")
    covered = F.col("__last.sum") + F.least(F.col(position), F.col("__last.end_char")) - F.col("__last.start_char")
    return rows.select(*points.columns, F.coalesce(covered, F.lit(0)).cast("long").alias("covered"))


def masked(predicted: DataFrame, gold: DataFrame, by: tuple[str, ...] = (), *, apart: bool = False) -> DataFrame:
    """(by, example_id, predicted_chars, tp_chars): characters masked, and those of them that are gold.

    ``by`` names columns that tell predictions apart, such as those of a policy; gold is there once for all.
    ``apart`` says that predictions share no characters, so that there is nothing to merge.
    """
    p = predicted.select(*by, "example_id", "start_char", "end_char")
    p = p if apart else merge_intervals(p, [*by, "example_id"])
    ends = F.explode(F.array(F.struct(F.col("start_char").alias("position"), F.lit(-1).alias("sign")), F.struct(F.col("end_char").alias("position"), F.lit(1).alias("sign")))).alias("e")
    points = p.select(*by, "example_id", ends).select(*by, "example_id", "e.position", "e.sign")
    rows = covered_before(points, merge_intervals(gold.select("example_id", "start_char", "end_char"), ["example_id"]))
    return rows.groupBy(*by, "example_id").agg(F.sum(F.col("sign") * F.col("position")).alias("predicted_chars"), F.sum(F.col("sign") * F.col("covered")).alias("tp_chars"))


def gold_lengths(gold: DataFrame, lengths: DataFrame) -> DataFrame:
    """(example_id, text_length, gold_chars, non_pii_chars) for every stream of ``lengths``."""
    g = merge_intervals(gold.select("example_id", "start_char", "end_char"), ["example_id"])
    g = g.groupBy("example_id").agg(F.sum(F.col("end_char") - F.col("start_char")).alias("gold_chars"))
    rows = lengths.join(g, "example_id", "left").na.fill(0, ["gold_chars"])
    return rows.withColumn("non_pii_chars", F.col("text_length") - F.col("gold_chars"))


def masking_counts(predicted: DataFrame, gold: DataFrame, lengths: DataFrame) -> DataFrame:
    """Per stream: characters masked, gold and both, whatever the label; (example_id, text_length) in ``lengths``."""
    rows = gold_lengths(gold, lengths).join(masked(predicted, gold), "example_id", "left").na.fill(0, ["tp_chars", "predicted_chars"])
    return rows.select("example_id", "text_length", "predicted_chars", "gold_chars", "tp_chars", "non_pii_chars")


def masking_rates() -> list[Column]:
    """Precision, recall, F1, F2 and false-positive rate of columns tp_chars, predicted_chars, gold_chars and non_pii_chars."""
    tp, predicted = F.col("tp_chars"), F.col("predicted_chars")
    p, r = ratio(tp, predicted), ratio(tp, F.col("gold_chars"))
    return [p.alias("masking_precision"), r.alias("masking_recall"), f_beta(p, r, 1).alias("masking_f1"), f_beta(p, r, 2).alias("masking_f2"), ratio(predicted - tp, F.col("non_pii_chars")).alias("masking_fpr")]


def masking_scores(counts: DataFrame) -> DataFrame:
    """Masking rates of each task from summed characters, pooled (``__overall__``) and as the mean of tasks (``__macro__``)."""
    sums = [F.sum(c).alias(c) for c in ("tp_chars", "predicted_chars", "gold_chars", "non_pii_chars")]
    pooled = counts.withColumn("task", F.explode(F.array("task", F.lit("__overall__")))).groupBy("task").agg(*sums)
    rows = pooled.select("task", *masking_rates())
    names = [c for c in rows.columns if c != "task"]
    return rows.unionByName(rows.where("task <> '__overall__'").agg(*(F.avg(c).alias(c) for c in names)).withColumn("task", F.lit("__macro__")))


def outcomes(committed: DataFrame, gold: DataFrame) -> DataFrame:
    """Per stream: commits, correct, wrong and missed; rows are not deduplicated."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    rows = committed.select(*KEY, one.alias("c"), none.alias("g")).unionByName(gold.select(*KEY, none.alias("c"), one.alias("g")))
    spans = rows.groupBy(*KEY).agg(F.sum("c").alias("c"), F.sum("g").alias("g"))  # how often each side has it, so each side is worked out once
    n = lambda c, when: F.coalesce(F.sum(F.when(when, F.col(c))), none)
    rows = spans.groupBy("example_id").agg(F.sum("c").alias("commits"), n("c", F.col("g") > 0).alias("correct"), F.sum("g").alias("gold"), n("g", F.col("c") == 0).alias("missed"))
    return rows.select("example_id", "commits", "correct", (F.col("commits") - F.col("correct")).alias("wrong"), "gold", "missed")


def premature(committed: DataFrame, reference: DataFrame) -> DataFrame:
    """Commits that are strict truncations of a reference with the same start and label; each counts once."""
    r = reference.groupBy("example_id", "start_word", "label").agg(F.max("end_word").alias("longest"))
    return committed.join(r, ["example_id", "start_word", "label"]).where("end_word < longest").select(*KEY)


def visibility(gold: DataFrame, steps: DataFrame) -> DataFrame:
    """The first step at which all of a gold entity is visible.

    Visible text never shrinks, so it is the step of the smallest length from the entity's end on:
    steps and ends are put in one order per stream, and an end looks ahead to the next step.
    """
    first = steps.groupBy("example_id", F.col("visible_char_count").alias("position")).agg(F.min(F.struct("step", "visible_word_count")).alias("seen"))
    ends = gold.select(*KEY, "end_char").distinct().withColumn("position", F.col("end_char")).withColumn("kind", F.lit(1))
    rows = side_by_side(first.withColumn("kind", F.lit(0)), ends, "position")
    ahead = Window.partitionBy("example_id").orderBy(F.desc("position"), "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("seen", F.last("seen", ignorenulls=True).over(ahead)).where("kind = 1 and seen is not null")
    return rows.select(*KEY, "end_char", F.col("seen.step").alias("visible_step"), F.col("seen.visible_word_count").alias("visible_words"))


def delays(committed: DataFrame, visible: DataFrame, steps: DataFrame) -> DataFrame:
    """Delays of correct commits: words of context beyond the entity, and updates since it was visible."""
    now = steps.select("example_id", "step", "visible_word_count")
    rows = committed.select(*KEY, "step").join(visible, KEY).join(now, ["example_id", "step"])
    return rows.select(*KEY, F.col("step").alias("commit_step"), (F.col("visible_word_count") - F.col("end_word") - 1).alias("context_words"), (F.col("step") - F.col("visible_step")).alias("update_delay"))


def delay_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: number, mean, median and 95th percentile of the words waited, and mean updates waited."""
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("context_words").alias("mean_words"),
        F.percentile("context_words", F.lit(0.5)).alias("median_words"),
        F.percentile("context_words", F.lit(0.95)).alias("p95_words"),
        F.avg("update_delay").alias("mean_updates"),
    )


def churn(snapshots: DataFrame, steps: DataFrame) -> DataFrame:
    """Per stream: entities that differ between adjacent snapshots, and those in either.

    An entity that was there a step before stays, which its own order of steps tells; snapshots are never compared as sets. Steps count
    without gaps, so all snapshots but the first have one before and all but the last one after.
    """
    was = F.lag("step").over(Window.partitionBy("example_id", "start_word", "end_word", "label").orderBy("step"))
    ends = steps.groupBy("example_id").agg(F.min("step").alias("first"), F.max("step").alias("last")).where("first < last")
    rows = snapshots.withColumn("was", was).where("was is null or was < step")  # one that is there twice counts once
    n = rows.groupBy("example_id", "step").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("was") == F.col("step") - 1).alias("stay"))
    n = ends.join(n, "example_id", "left").where("step is null or step between first and last")
    sums = n.groupBy("example_id").agg(*(F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(name) for name, c in (("sides", F.when(F.col("step") > F.col("first"), F.col("n")).otherwise(F.lit(0)) + F.when(F.col("step") < F.col("last"), F.col("n")).otherwise(F.lit(0))), ("stay", F.col("stay")))))
    return sums.select("example_id", (F.col("sides") - 2 * F.col("stay")).alias("changed"), (F.col("sides") - F.col("stay")).alias("either"))


def revision_horizons(updates: DataFrame, minimum_delta: float | None = None) -> DataFrame:
    """Words visible beyond a span at its last rescore; with ``minimum_delta`` the last that changed it or its label."""
    span = Window.partitionBy("example_id", "start_word", "end_word").orderBy("step")
    rows = updates.withColumn("before", F.lag("top_label").over(span)).where("update_kind = 'rescore'")
    if minimum_delta is not None:
        rows = rows.where((F.abs("top_probability_delta") >= minimum_delta) | (F.col("before") != F.col("top_label")))
    return rows.groupBy("example_id", "start_word", "end_word").agg(F.max_by("tail_distance_words", "step").alias("horizon_words"))


def trajectory_stability(obs: DataFrame) -> DataFrame:
    """Per trajectory: scores, population variance, largest and mean change, changes of direction (no change has none) and of rank.

    The rank of a label is its place among the labels of its span at a score, the best first.
    """
    key = Window.partitionBy(*KEY).orderBy("step")
    ranked = obs.withColumn("rank", F.row_number().over(Window.partitionBy("example_id", "start_word", "end_word", "step").orderBy(F.desc("probability"), "label")))
    ranked = ranked.withColumn("moved", (F.col("rank") != F.lag("rank").over(key)).cast("long"))
    sign = F.when(F.col("delta") != 0, F.signum("delta"))
    ranked = ranked.withColumn("turned", (sign != F.last(sign, ignorenulls=True).over(key.rowsBetween(Window.unboundedPreceding, -1))).cast("long"))  # against the last change
    return ranked.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("scores"),
        F.var_pop("probability").alias("variance"),
        F.coalesce(F.max(F.abs("delta")), F.lit(0.0)).alias("max_change"),
        F.coalesce(F.avg(F.abs("delta")), F.lit(0.0)).alias("mean_change"),
        F.coalesce(F.sum("moved"), F.lit(0)).alias("rank_changes"),
        F.coalesce(F.sum("turned"), F.lit(0)).alias("direction_changes"),
    )


def task_scores(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1 of each task, pooled (``__overall__``) and as the mean of tasks (``__macro__``)."""
    pooled = counts.groupBy("task").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn"))).unionByName(counts.agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn"))).withColumn("task", F.lit("__overall__")))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    rows = pooled.select("task", p.alias("precision"), r.alias("recall"), f_beta(p, r, 1).alias("f1"))
    macro = rows.where("task <> '__overall__'").agg(*(F.avg(c).alias(c) for c in ("precision", "recall", "f1"))).withColumn("task", F.lit("__macro__"))
    return rows.unionByName(macro)
