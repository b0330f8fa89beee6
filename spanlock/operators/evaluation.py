"""Evaluation records of policies: one row for each policy and stream, rows of groups, and choices among policies.

Everything that does not depend on a policy (gold, silver, churn) is worked out once per stream
and joined to the streams of each policy; nothing is paired that does not belong together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import metrics as M
from .policies import KEY
from .selection import pareto_2d
from .specs import Spec

#: Additive counts of an evaluation record.
COUNTS = (
    "commits", "correct", "wrong", "gold", "missed", "gold_premature", "silver_premature", "tp", "fp", "fn", "tp_chars", "predicted_chars", "gold_chars", "non_pii_chars",
    "blocked", "churn_changed", "churn_either", "boundaries_moved", "boundaries_compared", "error_numerator", "error_denominator",
)
MACRO = ("strict_precision", "strict_recall", "strict_f1", "masking_precision", "masking_recall", "masking_f1", "masking_f2", "masking_fpr", "mean_context_words")


def example_rows(policies: list[str], streams: DataFrame, committed: DataFrame, ready: DataFrame, gold: DataFrame, silver: DataFrame, churn: DataFrame, boundaries: DataFrame) -> DataFrame:
    """(policy_id, example_id, task, ``COUNTS``): the evaluation record of every policy and stream.

    streams: example_id, task, text_length. committed: policy_id, key, step, start_char, end_char, rows, each key once
    for a policy, whose commits share no word. ready: policy_id, key, rows (how many ready rows it has), for the committed keys too. gold: key, start_char, end_char, maybe repeated. silver: key.
    A commit is correct if it is a gold entity; premature if a reference with its start and label is longer.
    The selection error counts wrong, premature and missed ones over commits and gold.
    """
    known = gold.groupBy(*KEY).agg(F.count(F.lit(1)).alias("copies"))
    begin = ["example_id", "start_word", "label"]
    of_start = known.groupBy(*begin).agg(F.max("end_word").alias("gold_end"), F.collect_list(F.struct("end_word", "copies")).alias("golds"))
    references = of_start.join(silver.groupBy(*begin).agg(F.max("end_word").alias("silver_end")), begin, "full")  # few ends for a start and label, so commits are dealt out once for all they are compared with
    rows = committed.join(references, begin, "left").withColumn("copies", F.get(F.filter("golds", lambda g: g["end_word"] == F.col("end_word")), 0)["copies"])
    per = ["policy_id", "example_id"]
    of_commits = rows.groupBy(*per).agg(
        F.count(F.lit(1)).alias("commits"),
        F.count("copies").alias("correct"),
        F.coalesce(F.sum("copies"), F.lit(0)).alias("found"),
        F.count_if(F.col("end_word") < F.col("gold_end")).alias("gold_premature"),
        F.count_if(F.col("end_word") < F.col("silver_end")).alias("silver_premature"),
        F.sum("rows").alias("own_rows"),
    )
    all_rows = ready.groupBy(*per).agg(F.sum("rows").alias("all_rows"))
    of_gold = known.groupBy("example_id").agg(F.sum("copies").alias("gold"), F.count(F.lit(1)).alias("gold_keys"))
    every = M.gold_lengths(gold, streams.select("example_id", "text_length")).drop("text_length").join(streams.select("example_id", "task"), "example_id")
    every = every.join(of_gold, "example_id", "left")
    every = every.join(churn.select("example_id", F.col("changed").alias("churn_changed"), F.col("either").alias("churn_either")), "example_id", "left")
    every = every.join(boundaries.select("example_id", F.col("moved").alias("boundaries_moved"), F.col("compared").alias("boundaries_compared")), "example_id", "left")
    every = every.withColumn("policy_id", F.explode(F.array(*map(F.lit, policies))))
    rows = every.join(of_commits, per, "left").join(M.masked(committed, gold, ("policy_id",), apart=True), per, "left").join(all_rows, per, "left").na.fill(0)
    rows = rows.withColumns({"blocked": F.col("all_rows") - F.col("own_rows"), "wrong": F.col("commits") - F.col("correct"), "missed": F.col("gold") - F.col("found"), "tp": F.col("correct"), "fp": F.col("commits") - F.col("correct"), "fn": F.col("gold_keys") - F.col("correct")})
    rows = rows.withColumns({"error_numerator": F.col("wrong") + F.col("gold_premature") + F.col("missed"), "error_denominator": F.col("commits") + F.col("gold")})
    return rows.select(*per, "task", *COUNTS)


def counted(ready: DataFrame) -> DataFrame:
    """(policy_id, key, step, probability, readiness, rows): the first ready row of each key, and how many it has."""
    first = F.min_by(F.struct("step", "probability", "readiness"), "step").alias("r")
    return ready.groupBy("policy_id", *KEY).agg(F.count(F.lit(1)).alias("rows"), first).select("policy_id", *KEY, "r.*", "rows")


def counted_scores(obs: DataFrame, steps: DataFrame, specs: list[Spec]) -> DataFrame:
    """What ``counted`` gives for thresholds and lags, from score events instead of states.

    A score holds to the step before the next. A threshold is met at all of these steps, a lag from the step at which the word
    that far behind the span is visible; so ready rows are counted as ends of intervals and never made.
    """
    if other := {s.family for s in specs} - {"fixed-threshold", "fixed-lag"}:
        raise ValueError(f"readiness of {sorted(other)} does not follow from single scores")
    of = [(s.policy_id, float(dict(s.parameters)["threshold"]), dict(s.parameters).get("lag_words")) for s in specs]
    counts = F.transform(F.array_sort(F.collect_list(F.struct("step", "visible_word_count"))), lambda x: x["visible_word_count"])
    seen = steps.groupBy("example_id").agg(counts.alias("seen"))
    rows = obs.where(F.col("probability") >= min(t for _, t, _ in of)).select(*KEY, "step", "next_step", "probability").join(seen, "example_id")
    stop = F.coalesce(F.col("next_step"), F.size("seen") + F.lit(1).cast("long"))

    def begin(lag: int | None) -> Column:
        if lag is None:
            return F.col("step")
        return F.greatest(F.col("step"), F.size(F.filter("seen", lambda n: n - 1 - F.col("end_word") < lag)) + F.lit(1).cast("long"))

    place = {lag: f"from_{i}" for i, lag in enumerate(dict.fromkeys(lag for *_, lag in of))}
    rows = rows.select(*KEY, "probability", stop.alias("stop"), *(begin(lag).alias(name) for lag, name in place.items()))

    def found(threshold: float, at: str) -> tuple[Column, Column]:
        met = (F.col("probability") >= threshold) & (F.col(at) < F.col("stop"))
        first = F.min(F.when(met, F.struct(F.col(at).alias("step"), F.col("probability"))))
        return first, F.sum(F.when(met, F.col("stop") - F.col(at)))

    cells = {name: found(t, place[lag]) for name, t, lag in of}
    met = rows.groupBy(*KEY).agg(*(c.alias(f"{what}_{i}") for i, (first, n) in enumerate(cells.values()) for what, c in (("first", first), ("rows", n))))
    each = F.array(*(F.struct(F.lit(name).alias("policy_id"), F.col(f"first_{i}").alias("first"), F.col(f"rows_{i}").alias("rows")) for i, name in enumerate(cells)))
    met = met.select(*KEY, F.explode(F.filter(each, lambda x: x["rows"].isNotNull())).alias("x"))
    return met.select("x.policy_id", *KEY, "x.first.step", "x.first.probability", F.col("x.first.probability").alias("readiness"), "x.rows")


def rates() -> dict[str, Column]:
    """Rates of summed ``COUNTS``."""
    c = F.col
    p, r = M.ratio(c("tp"), c("tp") + c("fp")), M.ratio(c("tp"), c("tp") + c("fn"))
    out = {"strict_precision": p, "strict_recall": r, "strict_f1": M.f_beta(p, r, 1)}
    out |= dict(zip(("masking_precision", "masking_recall", "masking_f1", "masking_f2", "masking_fpr"), M.masking_rates()))
    return out | {
        "wrong_rate": M.ratio(c("wrong"), c("commits")),
        "missed_rate": M.ratio(c("missed"), c("gold")),
        "gold_premature_rate": M.ratio(c("gold_premature"), c("commits")),
        "silver_premature_rate": M.ratio(c("silver_premature"), c("commits")),
        "error_rate": M.ratio(c("error_numerator"), c("error_denominator")),
        "blocked_per_100_commits": M.ratio(c("blocked") * 100.0, c("commits")),
        "churn": M.ratio(c("churn_changed"), c("churn_either")),
        "boundary_revision_rate": M.ratio(c("boundaries_moved"), c("boundaries_compared")),
    }


def group_rows(examples: DataFrame, delays: DataFrame) -> DataFrame:
    """(policy_id, task): summed counts, rates and delays of each task and of all streams (``__overall__``).

    delays: policy_id, task, context_words, update_delay, model_delay, policy_delay. Rows of
    ``__overall__`` also have ``task_macro_`` columns, the plain means of the tasks.
    """
    both = lambda df: df.withColumn("task", F.explode(F.array("task", F.lit("__overall__"))))
    sums = both(examples).groupBy("policy_id", "task").agg(F.count(F.lit(1)).alias("examples"), *(F.sum(x).alias(x) for x in COUNTS))
    waits = both(delays).groupBy("policy_id", "task").agg(
        F.avg("context_words").alias("mean_context_words"),
        F.percentile("context_words", F.lit(0.5)).alias("median_context_words"),
        F.avg("update_delay").alias("mean_update_delay"),
        F.avg("model_delay").alias("mean_model_delay"),
        F.avg("policy_delay").alias("mean_policy_delay"),
    )
    rows = sums.join(waits, ["policy_id", "task"], "left").na.fill(0.0, [c for c in waits.columns if "_" in c and c != "policy_id"])
    rows = rows.withColumns(rates())
    macro = rows.where("task <> '__overall__'").groupBy("policy_id").agg(*(F.avg(x).alias(f"task_macro_{x}") for x in MACRO)).withColumn("task", F.lit("__overall__"))
    return rows.join(macro, ["policy_id", "task"], "left")


def pareto_rows(groups: DataFrame, specs: DataFrame) -> DataFrame:
    """(objective, policy_id): deployable policies that no other beats in delay and error, or in delay and F1."""
    rows = groups.where("task = '__overall__'").join(specs.where("not analysis_only").select("policy_id"), "policy_id")
    rows = rows.withColumn("negative_f1", -F.col("strict_f1"))
    fronts = {"delay_vs_error": "error_rate", "delay_vs_strict_f1": "negative_f1"}
    parts = [pareto_2d(rows, "mean_context_words", y).select(F.lit(name).alias("objective"), "policy_id").repartition("policy_id", F.lit(name)) for name, y in fronts.items()]
    return parts[0].unionByName(parts[1])


def matched(groups: DataFrame, specs: DataFrame, reference: str, tolerance: float = 1e-12) -> DataFrame:
    """(selection_key, mode, policy_id): the best policy of each kind at the reference's quality, and at its delay.

    quality: precision not below the reference's, then least delay, error, most F1. latency: delay not above the
    reference's, then least error, premature rate, most precision, least delay. Where no policy of a
    kind qualifies all of it compete. The reference stands for its own kind.
    """
    rows = groups.where("task = '__overall__'").join(F.broadcast(specs.select("policy_id", "selection_key")), "policy_id")
    at = rows.where(F.col("policy_id") == reference).select(F.col("selection_key").alias("own_key"), F.col("strict_precision").alias("p0"), F.col("mean_context_words").alias("d0")).limit(1)
    rows = rows.join(F.broadcast(at), F.lit(True))  # one row
    rows = rows.where((F.col("selection_key") != F.col("own_key")) | (F.col("policy_id") == reference))
    orders = {
        "quality": [F.col("strict_precision") + tolerance < F.col("p0"), F.col("mean_context_words"), F.col("error_rate"), -F.col("strict_f1")],
        "latency": [F.col("mean_context_words") > F.col("d0") + tolerance, F.col("error_rate"), F.col("gold_premature_rate"), -F.col("strict_precision"), F.col("mean_context_words")],
    }
    first = lambda order: F.min_by("policy_id", F.struct(*(c.alias(f"o{i}") for i, c in enumerate([*order, F.col("policy_id")]))))
    best = rows.groupBy("selection_key").agg(F.array(*(F.struct(F.lit(mode).alias("mode"), first(order).alias("policy_id")) for mode, order in orders.items())).alias("best"))
    return best.select("selection_key", F.explode("best").alias("b")).select("selection_key", "b.mode", "b.policy_id")


def premise_rows(updates: DataFrame, churn: DataFrame, extensions: DataFrame) -> DataFrame:
    """Per stream: what its log says of revisions: rescores, rescored spans, movement, churn, extensions and horizons.

    The movement is the sum and number of changes of rescores that have a score before. A span's horizon is as in ``metrics.revision_horizons``,
    from the same aggregate, so the log is read once.
    """
    rescored = F.col("update_kind") == "rescore"
    spans = updates.groupBy("example_id", "start_word", "end_word").agg(
        F.count(F.lit(1)).alias("updates"),
        F.count_if(F.col("update_kind") == "rescore").alias("rescores"),
        F.count_if((F.col("update_kind") == "rescore") & F.col("previous_top_probability").isNull()).alias("without_previous"),
        F.sum(F.when(F.col("update_kind") == "rescore", F.abs("top_probability_delta"))).alias("movement"),
        F.count(F.when(F.col("update_kind") == "rescore", F.col("top_probability_delta"))).alias("moves"),
        F.max_by(F.when(rescored, F.col("tail_distance_words")), F.when(rescored, F.col("step"))).alias("horizon"),
    )
    rows = spans.groupBy("example_id").agg(*(F.sum(c).alias(c) for c in ("updates", "rescores", "without_previous")), F.count(F.lit(1)).alias("spans"), F.count_if(F.col("rescores") > 0).alias("rescored_spans"), F.coalesce(F.sum("movement"), F.lit(0.0)).alias("movement"), F.sum("moves").alias("moves"), F.sum("horizon").alias("horizon_words"), F.count("horizon").alias("horizons"))
    rows = rows.join(churn.select("example_id", F.col("changed").alias("churn_changed"), F.col("either").alias("churn_either")), "example_id", "left")
    rows = rows.join(extensions.groupBy("example_id").agg(F.count(F.lit(1)).alias("extensions")), "example_id", "left")
    last = ["horizon_words", "horizons"]
    return rows.select(*(c for c in rows.columns if c not in last), *last).na.fill(0)


def premise_report(rows: DataFrame) -> DataFrame:
    """One row: the rates of all streams together."""
    total = rows.agg(F.count(F.lit(1)).alias("streams"), *(F.sum(c).alias(c) for c in rows.columns if c != "example_id"))
    c = F.col
    return total.select(
        "streams", "updates", "rescores", "spans", "rescored_spans", "without_previous", "extensions",
        M.ratio(c("rescores"), c("updates")).alias("rescore_rate"),
        M.ratio(c("rescored_spans"), c("spans")).alias("rescored_span_rate"),
        M.ratio(c("movement"), c("moves")).alias("mean_movement"),
        M.ratio(c("churn_changed"), c("churn_either")).alias("churn"),
        M.ratio(c("horizon_words"), c("horizons")).alias("mean_horizon_words"),
    )


def scalar_rows(examples: DataFrame, policies: tuple[str, str]) -> DataFrame:
    """(task, example_id, and for each of two policies the sums that rates are made of): rows for the bootstrap, paired by stream."""
    sides = []
    for name, policy in zip(("baseline", "comparison"), policies):
        sides.append(examples.where(F.col("policy_id") == policy).select("task", "example_id", *(F.col(c).cast("double").alias(f"{name}_{c}") for c in ("error_numerator", "error_denominator", "tp", "commits"))))
    return sides[0].join(sides[1], ["task", "example_id"])


def pivoted(groups: DataFrame, specs: DataFrame, keys: list[str], value: str = "strict_f1") -> DataFrame:
    """Tasks as rows and kinds of policies as columns: the best value of each kind."""
    rows = groups.join(F.broadcast(specs.select("policy_id", "selection_key")), "policy_id")
    return rows.groupBy("task").pivot("selection_key", keys).agg(F.max(value))
