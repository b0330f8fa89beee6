"""Sums that merge: exact multisets of values, and errors of two logs from events to cases to tasks.

Everything here is kept in a form in which parts can be put together without the rows they came from: a multiset is
a count for each value, an error is its number, sum and maximum, a case is its counts and its first fault. So a
log that is compared in portions, or a level above the one that was stored, needs no second pass over events.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- multisets ---


def multiset(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, n): how often each value occurs; null values do not."""
    return rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def merge(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """One multiset of several of the same keys, or the multiset of fewer keys."""
    return reduce(DataFrame.unionByName, parts).groupBy(*keys, "value").agg(F.sum("n").alias("n"))


def distribution(counts: DataFrame, keys: list[str], percentiles: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """(keys, n, mean, p<percent>..., least, largest, values): exact figures of a multiset by fewer or the same keys, with its values as a map.

    Percentiles are interpolated between neighbours, as over the rows themselves.
    """
    counts = merge([counts], keys)
    quantile = lambda q: F.expr(f"percentile(value, {q}, n)").alias(f"p{round(q * 100)}")
    values = F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "n"))))
    return counts.groupBy(*keys).agg(F.sum("n").alias("total"), (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"), *map(quantile, percentiles), F.min("value").alias("least"), F.max("value").alias("largest"), values.alias("values")).withColumnRenamed("total", "n")


def levels(counts: DataFrame, of: list[list[str]], names: list[str], **options) -> DataFrame:
    """The distributions of one multiset at several levels, each a list of its keys; a key that a level does not have is ``whole``."""
    parts = []
    for keys in of:
        rows = distribution(counts.withColumns({k: F.lit("__all__") for k in names if k not in keys}), names, **options)
        parts.append(rows.withColumn("level", F.lit("/".join(keys) or "all")))
    return reduce(DataFrame.unionByName, parts)


# --- errors of two logs ---

#: Differences that are explained by a score close to a bound: counted, but no fault.
TOLERATED = ("near_tie", "near_threshold")
CATEGORIES = ("missing", "unexpected", "width", "cosine", "probability", "margin", "delta", "kind", "top_label", "near_tie", "threshold", "near_threshold")
ERRORS = ("probability_error", "margin_error", "delta_error")


def case_sums(compared: DataFrame, task: Column) -> DataFrame:
    """One row for each case (task, example_id) of compared events, in a form that merges.

    events and faulty ones; each error as (n, total, largest); the least cosine; how many events have each category; and the
    first fault by step and span, with its reasons.
    """
    faults = F.filter("differences", lambda d: ~d.isin(*TOLERATED))
    faulty = F.size(faults) > 0
    return compared.groupBy(task.alias("task"), "example_id").agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(faulty).alias("faulty"),
        *(F.struct(F.count(e).alias("n"), F.coalesce(F.sum(e), F.lit(0.0)).alias("total"), F.max(e).alias("largest")).alias(e) for e in ERRORS),
        F.min("cosine").alias("least_cosine"),
        F.struct(*(F.count_if(F.array_contains("differences", c)).alias(c) for c in CATEGORIES)).alias("categories"),
        F.min(F.when(faulty, F.struct("step", "start_word", "end_word", faults.alias("reasons")))).alias("first"),
    )


def merge_cases(parts: list[DataFrame]) -> DataFrame:
    """The cases of a log of which portions were compared apart."""
    rows = reduce(DataFrame.unionByName, parts)
    return rows.groupBy("task", "example_id").agg(
        F.sum("events").alias("events"), F.sum("faulty").alias("faulty"), *(_merged(e) for e in ERRORS), F.min("least_cosine").alias("least_cosine"), F.struct(*(F.sum(f"categories.{c}").alias(c) for c in CATEGORIES)).alias("categories"), F.min("first").alias("first")
    )


def _merged(error: str) -> Column:
    return F.struct(F.sum(f"{error}.n").alias("n"), F.sum(f"{error}.total").alias("total"), F.max(f"{error}.largest").alias("largest")).alias(error)


def roll_up(cases: DataFrame) -> DataFrame:
    """Cases, tasks and the whole as rows of one table, from the cases alone.

    level, task, example_id, events, faulty_events, cases, faulty_cases, mean and largest of each error, least_cosine, for each category its
    events and its cases (a case counts once), and first_step with first_reasons, which only cases have.
    """
    level = F.grouping_id("task", "example_id")
    per = {c: F.col(f"categories.{c}") for c in CATEGORIES}
    rows = cases.rollup("task", "example_id").agg(
        F.element_at(F.array(F.lit("case"), F.lit("task"), F.lit(None), F.lit("all")), (level + 1).cast("int")).alias("level"),
        F.sum("events").alias("events"),
        F.sum("faulty").alias("faulty_events"),
        F.count(F.lit(1)).alias("cases"),
        F.count_if(F.col("faulty") > 0).alias("faulty_cases"),
        *(_merged(e) for e in ERRORS),
        F.min("least_cosine").alias("least_cosine"),
        F.struct(*(F.struct(F.sum(n).alias("events"), F.count_if(n > 0).alias("cases")).alias(c) for c, n in per.items())).alias("categories"),
        F.when(level == 0, F.min("first")).alias("first"),
    )
    means = [c for e in ERRORS for c in (F.when(F.col(f"{e}.n") > 0, F.col(f"{e}.total") / F.col(f"{e}.n")).alias(f"mean_{e}"), F.col(f"{e}.largest").alias(f"max_{e}"))]
    return rows.select("level", "task", "example_id", "events", "faulty_events", "cases", "faulty_cases", *means, "least_cosine", "categories", F.col("first.step").alias("first_step"), F.array_join("first.reasons", ",").alias("first_reasons"))


def category_rows(rolled: DataFrame) -> DataFrame:
    """(level, task, example_id, category, events, cases): the categories that occur, as rows."""
    cells = F.array(*(F.struct(F.lit(c).alias("category"), F.col(f"categories.{c}.events").alias("events"), F.col(f"categories.{c}.cases").alias("cases")) for c in CATEGORIES))
    rows = rolled.select("level", "task", "example_id", F.explode(F.filter(cells, lambda x: x["events"] > 0)).alias("c"))
    return rows.select("level", "task", "example_id", "c.category", "c.events", "c.cases")
