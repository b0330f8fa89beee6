"""Passes that were mended for large tables: batches instead of groups, one look at the log."""

from __future__ import annotations

from functools import partial

import pyarrow as pa
from pyspark.sql import functions as F

from spanlock.operators import resolve as R
from spanlock.operators import updates as U
from spanlock.plans import queries as Q


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_taken_words_are_carried_over_batches():
    rows = pa.table({"example_id": [1, 1, 1, 1, None, None], "start_word": [0, 2, 1, 3, 0, 1], "end_word": [1, 3, 2, 3, 1, 1], "__row": [1, 2, 3, 4, 1, 2]})
    whole = pa.Table.from_batches(list(R._free(iter(rows.to_batches()), ["example_id"])))
    for size in (1, 2, 3):
        parts = pa.Table.from_batches(list(R._free(iter(rows.to_batches(max_chunksize=size)), ["example_id"])))
        assert parts.equals(whole.combine_chunks()) or parts.to_pylist() == whole.to_pylist()
    assert [(r["example_id"], r["start_word"]) for r in whole.to_pylist()] == [(1, 0), (1, 2), (None, 0)]


def test_overlaps_are_resolved_in_batches_and_not_in_groups_of_a_stream(spark, sf_dir):
    plan = plan_of(R.greedy_decode(Q.stream(spark, sf_dir).states, 0.9))
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan


def test_observations_sort_the_log_once(spark):
    how = U.Scoring(right_context=3)
    steps = U.with_word_counts(spark.createDataFrame([(1, s, "a b c d ") for s in range(1, 6)], "example_id long, step long, chunk string"))
    obs = U.observations(U.span_updates(U.hash_scorer(U.candidates(steps, how), how), how), how)
    assert plan_of(obs).count("Sort [example_id") <= 2  # steps, then spans; not once more for labels
    rows = {(r.start_word, r.end_word, r.label, r.step): r for r in obs.collect()}
    for (a, b, label, _), r in rows.items():
        before = [rows[k] for k in sorted(k for k in rows if k[:3] == (a, b, label) and k[3] <= r.step)]
        p = [x.probability for x in before]
        assert r.rescore_count == len(p) and r.rolling_deltas == [y - x for x, y in zip(p, p[1:])][-3:]
        assert r.instability == max(map(abs, r.rolling_deltas), default=0.0) and r.previous == (p[-2] if len(p) > 1 else None)


def test_gold_is_read_off_one_order_of_the_words(spark, sf_dir):
    s = Q.stream(spark, sf_dir)
    assert "Join" not in plan_of(s.gold)
    end = s.words.select("example_id", F.col("word_index").alias("end_word"), F.col("end_char").alias("e"))
    assert s.gold.join(end, ["example_id", "end_word"]).where("end_char = e").count() == s.gold.count() > 0
