"""Comparing two event logs of the same streams: numbers, labels, kinds, and what explains a difference."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Tolerances:
    """What counts as equal. Those of the published comparison."""

    cosine: float = 0.9999
    least_norm: float = 1e-3
    probability: float = 5e-3
    margin: float = 5e-3
    delta: float = 5e-3
    tie_margin: float = 0.1
    tie_probability: float = 1e-6
    near_threshold: float = 5e-3


def _top(probs: Column) -> Column:
    return F.array_position(probs, F.array_max(probs))


def logits(probs: Column) -> Column:
    """Log odds; probabilities are kept off 0 and 1 by 1e-12."""
    safe = lambda p: F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), p))
    return F.transform(probs, lambda p: F.log(safe(p) / (F.lit(1.0) - safe(p))))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def compare_updates(expected: DataFrame, actual: DataFrame, how: Tolerances = Tolerances(), threshold: float = 0.5) -> DataFrame:
    """One row for each span and step that either log has: errors, and ``differences`` with its reasons (empty: none).

    Reasons: missing, unexpected, width, cosine, probability, margin, delta, kind; top_label, or near_tie if the
    expected best labels are so close that their order means nothing; threshold, or near_threshold if
    a label crosses the threshold within the tolerance. ``expected_kind`` is the kind of the expected event, null if it is missing there.
    """
    key = ["example_id", "step", "start_word", "end_word"]
    sides = [df.select(*key, F.struct("probs", "update_kind", "top_probability_delta", "label_margin").alias(name)) for df, name in ((expected, "e"), (actual, "a"))]
    rows = sides[0].join(sides[1], key, "full")
    ep, ap = F.col("e.probs"), F.col("a.probs")
    rows = rows.withColumns({"el": logits(ep), "al": logits(ap)})
    norm = lambda c: F.sqrt(_dot(F.col(c), F.col(c)))
    least = F.least(norm("el"), norm("al"))
    rows = rows.withColumns(
        {
            "same_width": F.size(ep) == F.size(ap),
            "cosine": F.when(least >= how.least_norm, _dot(F.col("el"), F.col("al")) / (norm("el") * norm("al"))),
            "probability_error": F.array_max(F.zip_with(ep, ap, lambda x, y: F.abs(x - y))),
            "margin_error": F.abs(F.col("e.label_margin") - F.col("a.label_margin")),
            "delta_error": F.abs(F.col("e.top_probability_delta") - F.col("a.top_probability_delta")),
        }
    )
    sorted_logits = F.sort_array("el", asc=False)
    tie = (F.get(sorted_logits, 0) - F.get(sorted_logits, 1) <= how.tie_margin) | (F.array_max(ep) <= how.tie_probability)
    top = _top(ep) != _top(ap)
    crossed = F.zip_with(ep, ap, lambda x, y: F.when((x > threshold) != (y > threshold), F.abs(x - threshold) <= how.near_threshold))
    both = F.col("e").isNotNull() & F.col("a").isNotNull()
    reasons = [
        (F.col("a").isNull(), "missing"),
        (F.col("e").isNull(), "unexpected"),
        (both & ~F.col("same_width"), "width"),
        (F.col("cosine") < how.cosine, "cosine"),
        (F.col("probability_error") > how.probability, "probability"),
        (F.col("margin_error") > how.margin, "margin"),
        (F.col("delta_error") > how.delta, "delta"),
        (both & (F.col("e.update_kind") != F.col("a.update_kind")), "kind"),
        (both & top & ~tie, "top_label"),
        (both & top & tie, "near_tie"),
        (F.exists(crossed, lambda c: ~c), "threshold"),
        (F.exists(crossed, lambda c: c), "near_threshold"),
    ]
    found = F.filter(F.array(*(F.when(condition, F.lit(name)) for condition, name in reasons)), lambda r: r.isNotNull())
    return rows.select(*key, "cosine", "probability_error", "margin_error", "delta_error", found.alias("differences"), F.col("e.update_kind").alias("expected_kind"))


def update_report(compared: DataFrame) -> DataFrame:
    """(reason, rows, examples): how often each reason is given, and ``__compared__`` for all rows."""
    reasons = F.explode(F.concat(F.array(F.lit("__compared__")), F.col("differences"))).alias("reason")
    return compared.select("example_id", reasons).groupBy("reason").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("example_id").alias("examples"))


def numeric_report(compared: DataFrame) -> DataFrame:
    """One row: least cosine and largest errors."""
    return compared.agg(F.min("cosine").alias("least_cosine"), *(F.max(c).alias(f"max_{c}") for c in ("probability_error", "margin_error", "delta_error")))


def compare_entities(expected: DataFrame, actual: DataFrame, score_error: float = 5e-3) -> DataFrame:
    """Per snapshot: entities that both have, that only one has, and that have unlike scores."""
    key = ["example_id", "step", "start_word", "end_word", "label"]
    rows = expected.select(*key, F.col("score").alias("e")).join(actual.select(*key, F.col("score").alias("a")), key, "full")
    return rows.groupBy("example_id", "step").agg(
        F.count_if(F.col("e").isNotNull() & F.col("a").isNotNull()).alias("agreed"),
        F.count_if(F.col("a").isNull()).alias("missing"),
        F.count_if(F.col("e").isNull()).alias("unexpected"),
        F.count_if(F.abs(F.col("e") - F.col("a")) > score_error).alias("other_score"),
    )


def agreement_matrix(compared: DataFrame) -> DataFrame:
    """Per kind of expected event: the part of the rows whose best label, threshold side and numbers agree."""
    has = lambda *reasons: F.arrays_overlap("differences", F.array(*map(F.lit, reasons)))
    part = lambda *reasons: F.avg((~has("missing", *reasons)).cast("double"))
    rows = compared.where(~has("unexpected")).withColumnRenamed("expected_kind", "update_kind")  # each has its kind already: nothing is joined
    return rows.groupBy("update_kind").agg(F.count(F.lit(1)).alias("rows"), part("top_label", "near_tie").alias("label"), part("threshold", "near_threshold").alias("side"), part("cosine", "probability", "margin", "delta", "width").alias("numbers"))
