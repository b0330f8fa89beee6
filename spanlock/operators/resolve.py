"""Conflict resolution: which ready candidates are committed.

Commits are permanent and a candidate that overlaps a commit stays blocked, so only a
candidate's first ready step can commit it, and the commits of a stream are one greedy pass
over first-ready rows in the order of step and rank. The pass keeps the words that are taken as sorted
intervals, so a row looks up its own words and is not compared with all rows kept before it.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .policies import KEY, first_ready

#: Conditions under which a kept row k blocks a row x: nested, they cross or are the same span.
OVERLAP = "k.start_word <= x.end_word and x.start_word <= k.end_word"
CROSSING = f"{OVERLAP} and (k.start_word < x.start_word) = (k.end_word < x.end_word) and (k.start_word > x.start_word) = (k.end_word > x.end_word)"


def _greedy(blocks: str) -> str:
    """SQL of the rows kept when ``rows`` are taken in order and blocked by those already kept."""
    return f"aggregate(rows, slice(rows, 1, 0), (kept, x) -> if(exists(kept, k -> {blocks}), kept, array_append(kept, x)))"


def _differs(column: pa.Array, a: slice, b: slice) -> np.ndarray:
    """Where values of a column differ; null is equal to null alone."""
    x, y = column[a], column[b]
    unlike = pc.fill_null(pc.not_equal(x, y), False)
    return pc.or_(unlike, pc.xor(pc.is_null(x), pc.is_null(y))).to_numpy(zero_copy_only=False)


def _free(batches: Iterator[pa.RecordBatch], within: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows that are kept of batches in order; a group may go on in the next batch, so what it has taken is carried over."""
    group, starts, ends = None, [], []
    for batch in batches:
        n, kept = batch.num_rows, []
        if n == 0:
            continue
        columns = [batch[c] for c in within]
        new = np.ones(n, dtype=bool)
        if n > 1:
            new[1:] = np.logical_or.reduce([_differs(c, slice(1, n), slice(0, n - 1)) for c in columns])
        first, group = tuple(c[0].as_py() for c in columns), (group, tuple(c[n - 1].as_py() for c in columns))
        new[0], group = first != group[0], group[1]
        for i, (begins, a, b) in enumerate(zip(new.tolist(), *(batch[c].to_numpy(zero_copy_only=False).tolist() for c in ("start_word", "end_word")))):
            if begins:
                starts, ends = [], []
            at = bisect_right(starts, b)  # kept intervals are apart, so the last that begins by the end of this one reaches furthest
            if not at or ends[at - 1] < a:
                starts.insert(at, a)
                ends.insert(at, b)
                kept.append(i)
        yield batch.take(pa.array(kept, pa.int64())).select(batch.schema.names[:-1])


def without_overlaps(rows: DataFrame, within: list[str], order: list[tuple[str, str]]) -> DataFrame:
    """The rows left when those of each stream and ``within`` are taken in order and one that shares a word with a kept one is dropped.

    Streams stay where they are. The window brings the rows of a stream together in order, and they are read in batches
    that hold parts of many streams; a task holds a batch and the intervals of one group.
    """
    ranks = [F.desc(c) if how == "descending" else F.asc(c) for c, how in order]
    ordered = rows.withColumn("__row", F.row_number().over(Window.partitionBy("example_id").orderBy(*within, *ranks)))
    return ordered.mapInArrow(partial(_free, within=["example_id", *within]), rows.schema)


def commits(ready: DataFrame, *, flat: bool = True, policy: tuple[str, ...] = (), keep: tuple[str, ...] = (), first: bool = False) -> DataFrame:
    """(policy, key, step, readiness): the committed candidates.

    Rank inside a step: readiness, probability (both falling), start, end, label. ``flat``
    blocks any overlap in words; without it every candidate commits when it is ready.
    ``policy`` names columns that tell policies apart, for a whole grid at once. ``keep`` names more columns of
    ``ready``, which must then be the first ready rows already; ``first`` says that they are.
    """
    first = ready if keep or first else first_ready(ready, policy)
    if not flat:
        return first.select(*policy, *KEY, "step", "readiness", *keep)
    rank = [("step", "ascending"), ("readiness", "descending"), ("probability", "descending"), ("start_word", "ascending"), ("end_word", "ascending"), ("label", "ascending")]
    return without_overlaps(first.select(*policy, *KEY, "step", "readiness", "probability", *keep), list(policy), rank).drop("probability")


def blocked_revisions(ready: DataFrame, committed: DataFrame) -> DataFrame:
    """Ready rows of candidates that never commit, per stream."""
    return ready.join(committed.select(*KEY), KEY, "left_anti").groupBy("example_id").agg(F.count(F.lit(1)).alias("blocked_revisions"))


def block_reasons(ready: DataFrame, committed: DataFrame) -> DataFrame:
    """(key, step, reason, blocker_start, blocker_step): why a ready row is blocked, and by which commit.

    ``committed_overlap`` if an overlapping commit is older than the row, ``ready_overlap`` if it
    was made in the same step; the blocker is the first by step and start. Spans meet by the words
    they share, an equi-join, and a word is in one commit at most.
    """
    words = lambda df: df.withColumn("word", F.explode(F.sequence("start_word", "end_word")))
    owners = words(committed.select("example_id", "start_word", "end_word", F.col("step").alias("at"))).select("example_id", "word", F.struct("at", F.col("start_word").alias("start")).alias("owner"))
    rows = ready.join(committed.select(*KEY), KEY, "left_anti")
    met = words(rows.select(*KEY, "step")).join(owners, ["example_id", "word"]).where("owner.at <= step")
    first = met.groupBy(*KEY, "step").agg(F.min("owner").alias("o"))
    return first.select(*KEY, "step", F.when(F.col("o.at") < F.col("step"), "committed_overlap").otherwise("ready_overlap").alias("reason"), F.col("o.start").alias("blocker_start"), F.col("o.at").alias("blocker_step"))


def greedy_decode(updates: DataFrame, threshold: float, *, flat: bool = True) -> DataFrame:
    """Entities of each snapshot: labels of the state above (not at) the threshold, best first.

    ``flat`` drops what overlaps a better one; without it spans may lie inside each other, and
    only those that cross a better span or are the same span with another label are dropped.
    """
    rows = updates.where(F.col("probability") > threshold).select("example_id", "step", "start_word", "end_word", "label", F.col("probability").alias("score"))
    if flat:
        return without_overlaps(rows, ["step"], [("score", "descending"), ("start_word", "ascending"), ("end_word", "ascending"), ("label", "ascending")])
    row = F.struct((-F.col("score")).alias("s"), "start_word", "end_word", "label")
    rows = rows.groupBy("example_id", "step").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return rows.select("example_id", "step", F.explode(F.expr(_greedy(CROSSING))).alias("k")).select("example_id", "step", "k.start_word", "k.end_word", "k.label", (-F.col("k.s")).alias("score"))
