"""From text streams to score events: words, candidates, scores, updates, trajectories."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx


@dataclass(frozen=True)
class Scoring:
    """Which spans are scored at an append, and for which labels."""

    max_width: int = 3
    right_context: int = 12
    labels: tuple[str, ...] = ("person", "place")


def stream_words(steps: DataFrame) -> DataFrame:
    """(example_id, step, word_index, word, start_char, end_char) with stream-wide numbers and offsets."""
    rows = tx.tokens(steps, ["example_id", "step", "first_char"], "chunk", tx.WORD)
    number = F.row_number().over(Window.partitionBy("example_id").orderBy("step", "token_index")) - 1
    return rows.select("example_id", "step", number.cast("long").alias("word_index"), F.col("token").alias("word"), (F.col("first_char") + F.col("start_char")).alias("start_char"), (F.col("first_char") + F.col("end_char")).alias("end_char"))


def with_word_counts(steps: DataFrame) -> DataFrame:
    """Adds visible_word_count and past_word_count."""
    order = Window.partitionBy("example_id").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    new = tx.count_words("chunk")
    rows = steps.withColumn("new", new)
    return rows.withColumn("visible_word_count", F.sum("new").over(order).cast("long")).withColumn("past_word_count", F.col("visible_word_count") - F.col("new")).drop("new")


def candidates(steps: DataFrame, how: Scoring) -> DataFrame:
    """(example_id, step, visible_word_count, start_word, end_word): spans scored at each append.

    Ends go back ``right_context`` words behind the last one, starts up to ``max_width`` words;
    an append without a new word scores nothing.
    """
    rows = steps.where("visible_word_count > past_word_count")
    last = F.col("visible_word_count") - 1
    first_end = F.least(F.col("past_word_count"), F.greatest(F.lit(0), last - how.right_context))
    rows = rows.select("example_id", "step", "visible_word_count", F.explode(F.sequence(first_end, last)).alias("end_word"))
    return rows.select("example_id", "step", "visible_word_count", F.explode(F.sequence(F.greatest(F.lit(0), F.col("end_word") - how.max_width + 1), F.col("end_word"))).alias("start_word"), "end_word")


def hash_probability(*parts: Column) -> Column:
    """A reproducible stand-in for a model: 32 hash bits of its arguments as a number in [0, 1)."""
    digest = F.md5(F.concat_ws("|", *(p.cast("string") for p in parts)))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long").cast("double") / F.lit(4294967296.0)


def hash_scorer(rows: DataFrame, how: Scoring) -> DataFrame:
    """Adds probs: one probability for each label, in the order of the labels."""
    return rows.withColumn("probs", F.array(*(hash_probability(F.col("example_id"), F.col("start_word"), F.col("end_word"), F.lit(label), F.col("step")) for label in how.labels)))


def with_best_label(scored: DataFrame, how: Scoring) -> DataFrame:
    """Adds top_probability, top_label_index and top_label: the first of the largest probabilities."""
    rows = scored.withColumn("top_probability", F.array_max("probs"))
    rows = rows.withColumn("top_label_index", (F.array_position("probs", F.col("top_probability")) - 1).cast("long"))
    return rows.withColumn("top_label", F.element_at(F.array(*map(F.lit, how.labels)), (F.col("top_label_index") + 1).cast("int")))


def span_updates(scored: DataFrame, how: Scoring) -> DataFrame:
    """Score events: the best and second label, margin, change against the span's last score, kind and tail distance.

    The best label is the first of the largest; the change compares largest probabilities even
    if the label changed.
    """
    span = Window.partitionBy("example_id", "start_word", "end_word").orderBy("step")
    rows = with_best_label(scored, how)
    rest = F.filter("probs", lambda p, i: i.cast("long") != F.col("top_label_index"))
    rows = rows.withColumn("second_probability", F.coalesce(F.array_max(rest), F.lit(0.0)))
    previous = F.lag("top_probability").over(span)
    return rows.select(
        "example_id",
        "step",
        "visible_word_count",
        "start_word",
        "end_word",
        "probs",
        "top_label_index",
        "top_label",
        "top_probability",
        "second_probability",
        (F.col("top_probability") - F.col("second_probability")).alias("label_margin"),
        previous.alias("previous_top_probability"),
        (F.col("top_probability") - previous).alias("top_probability_delta"),
        F.when(previous.isNull(), "new").otherwise("rescore").alias("update_kind"),
        (F.col("visible_word_count") - 1 - F.col("end_word")).alias("tail_distance_words"),
    )


def replay(updates: DataFrame, through_step: int | None = None) -> DataFrame:
    """The state after a step: the last vector of every span."""
    rows = updates if through_step is None else updates.where(F.col("step") <= through_step)
    return rows.groupBy("example_id", "start_word", "end_word").agg(F.max_by("probs", "step").alias("probs"), F.max("step").alias("last_step"))


def observations(updates: DataFrame, how: Scoring, rolling: int = 3) -> DataFrame:
    """Trajectories: one row per span, label and score, with counts, changes and the last changes.

    Labels of a span are scored together, so the scores before and after are looked up once for all of them, in the
    order that the score events have already; only then is a row made for each label.
    """
    labels = F.array(*map(F.lit, how.labels))
    span = Window.partitionBy("example_id", "start_word", "end_word").orderBy("step")
    before = [F.lag("probs", i).over(span).alias(f"__before{i}") for i in range(1, rolling + 1)]
    rows = updates.select("example_id", "start_word", "end_word", "step", "visible_word_count", "label_margin", "probs", F.row_number().over(span).cast("long").alias("rescore_count"), F.lead("step").over(span).alias("next_step"), *before)
    rows = rows.withColumn("__i", F.explode(F.array(*(F.lit(i) for i in range(len(how.labels))))))
    scores = [F.get(c, F.col("__i")) for c in ("probs", *(f"__before{i}" for i in range(1, rolling + 1)))]
    deltas = [now - was for now, was in zip(scores, scores[1:])]
    rolled = F.array().cast("array<double>")
    for i, d in enumerate(deltas):  # a score that has no i-th change has no earlier one either
        rolled = F.when(d.isNotNull(), F.array(*reversed(deltas[: i + 1]))).otherwise(rolled)
    largest = F.greatest(*(F.abs(d) for d in deltas)) if rolling > 1 else F.abs(deltas[0])
    return rows.select("example_id", "start_word", "end_word", F.get(labels, F.col("__i")).alias("label"), "step", "visible_word_count", "label_margin", scores[0].alias("probability"), "rescore_count", scores[1].alias("previous"), deltas[0].alias("delta"), rolled.alias("rolling_deltas"), "next_step", F.coalesce(largest, F.lit(0.0)).alias("instability"))


def families(obs: DataFrame) -> DataFrame:
    """Spans that begin at the same word with the same label."""
    return obs.groupBy("example_id", "start_word", "label").agg(F.sort_array(F.collect_set("end_word")).alias("end_words"), F.max("end_word").alias("longest_end_word"))


def overlap_components(obs: DataFrame) -> DataFrame:
    """Spans of one label that overlap transitively in words; touching words do not."""
    spans = obs.select("example_id", "label", "start_word", "end_word").distinct()
    order = Window.partitionBy("example_id", "label").orderBy("start_word", "end_word")
    reach = F.max("end_word").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.withColumn("opens", (reach.isNull() | (F.col("start_word") > reach)).cast("int"))
    rows = rows.withColumn("component", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.groupBy("example_id", "label", "component").agg(F.min("start_word").alias("first_word"), F.max("end_word").alias("last_word"), F.count(F.lit(1)).alias("spans"))


def candidate_states(obs: DataFrame, steps: DataFrame) -> DataFrame:
    """Every span and label seen so far, at every step: the last score carried forward.

    An observation holds from its step to the one before the next. Steps count from 1 without
    gaps (see ``traces.violations``), so those are a slice of the stream's word counts, which an
    observation gets by stream; no pairs of scores and steps are made that do not hold.
    """
    counts = F.transform(F.array_sort(F.collect_list(F.struct("step", "visible_word_count"))), lambda x: x["visible_word_count"])
    seen = steps.groupBy("example_id").agg(counts.alias("seen"))
    stop = F.coalesce(F.col("next_step"), F.size("seen") + F.lit(1).cast("long"))
    held = F.slice("seen", F.col("step").cast("int"), (stop - F.col("step")).cast("int"))
    rows = obs.drop("visible_word_count").join(seen, "example_id")
    rows = rows.select(*obs.drop("visible_word_count").columns, F.posexplode(held).alias("snapshot_age", "words_now")).withColumn("snapshot_age", F.col("snapshot_age").cast("long"))
    return rows.select("example_id", (F.col("step") + F.col("snapshot_age")).alias("step"), "start_word", "end_word", "label", "probability", "rescore_count", "snapshot_age", (F.col("snapshot_age") == 0).alias("was_rescored"), (F.col("words_now") - 1 - F.col("end_word")).alias("tail_distance_words"), "rolling_deltas", "instability", "label_margin")


def states_by_step(updates: DataFrame) -> DataFrame:
    """The state after every step that has an event: the last vector of each span seen so far.

    A vector holds from its step to the event step before the span's next score; event steps are numbered, so
    those are a slice of the stream's event steps.
    """
    at = updates.groupBy("example_id").agg(F.array_sort(F.collect_set("step")).alias("at"))
    span = Window.partitionBy("example_id", "start_word", "end_word").orderBy("step")
    rows = updates.select("example_id", "step", "start_word", "end_word", "probs", F.lead("step").over(span).alias("next")).join(at, "example_id")
    held = F.filter("at", lambda s: (s >= F.col("step")) & (F.col("next").isNull() | (s < F.col("next"))))
    return rows.select("example_id", F.explode(held).alias("at"), "start_word", "end_word", "probs").withColumnRenamed("at", "step")


def state_digests(state: DataFrame, digits: int = 9) -> DataFrame:
    """(example_id, sha256): a digest of each stream's state, over its spans in order with rounded vectors."""
    number = lambda p: F.round(p * 10**digits, 0).cast("long").cast("string")
    line = F.concat_ws(",", F.col("start_word").cast("string"), F.col("end_word").cast("string"), F.array_join(F.transform("probs", number), ","))
    rows = state.select("example_id", F.struct("start_word", "end_word", line.alias("line")).alias("s"))
    lines = F.transform(F.array_sort(F.collect_list("s")), lambda s: s["line"])
    return rows.groupBy("example_id").agg(F.sha2(F.array_join(lines, "\n"), 256).alias("sha256"))


def cold_candidates(words: DataFrame, max_width: int) -> DataFrame:
    """All spans of up to ``max_width`` words of the whole text of each stream."""
    last = words.groupBy("example_id").agg(F.max("word_index").alias("last"))
    rows = last.select("example_id", "last", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("start_word"))
    return rows.select("example_id", "start_word", F.explode(F.sequence("start_word", F.least("last", F.col("start_word") + max_width - 1))).alias("end_word"))


def family_states(states: DataFrame) -> DataFrame:
    """At every step the spans that begin at a word with a label: how many, the longest, and the best."""
    best = F.max_by("end_word", F.struct("probability", "end_word"))
    return states.groupBy("example_id", "step", "start_word", "label").agg(F.count(F.lit(1)).alias("members"), F.max("end_word").alias("longest_end_word"), best.alias("best_end_word"), F.max("probability").alias("best_probability"))
