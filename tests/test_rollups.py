"""Sums that merge."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanlock.operators import parity as C
from spanlock.operators import rollups as L

LOG = "example_id long, step long, start_word long, end_word long, probs array<double>, update_kind string, top_probability_delta double, label_margin double"


def test_a_multiset_gives_what_the_rows_give_at_every_level(spark):
    rng = np.random.default_rng(1)
    data = [(f"t{i % 3}", "ab"[i % 2], None if i % 10 == 0 else int(v)) for i, v in enumerate(rng.integers(0, 9, 200))]
    rows = spark.createDataFrame(data, "task string, label string, v long")
    parts = [L.multiset(rows.where(p), ["task", "label"], "v") for p in ("v % 2 = 0", "v % 2 = 1")]
    counts = L.merge(parts, ["task", "label"])
    for keys in (["task", "label"], ["task"], []):
        for r in L.distribution(counts, keys, (0.25, 0.5, 0.95)).collect():
            of = [v for t, l, v in data if v is not None and all(r[k] == x for k, x in (("task", t), ("label", l)) if k in keys)]
            assert (r["n"], r["least"], r["largest"]) == (len(of), min(of), max(of)) and r["mean"] == pytest.approx(np.mean(of))
            assert (r["p25"], r["p50"], r["p95"]) == pytest.approx(tuple(np.percentile(of, [25, 50, 95])))
            assert r["values"] == {v: of.count(v) for v in set(of)}
    assert L.distribution(counts.where("false"), ["task"]).isEmpty()
    assert {r["level"] for r in L.levels(counts, [["task"], []], ["task", "label"]).collect()} == {"task", "all"}


@pytest.fixture(scope="module")
def compared(spark):
    """Three streams: one equal, one with a fault at two steps, one that differs only near the threshold."""
    sound = [(e, s, w, w, [0.9, 0.2], "new", None, 0.7) for e in (1, 2, 5) for s in (1, 2, 3) for w in (0, 1)]
    other = {(2, 2, 1): [0.7, 0.2], (2, 3, 0): [0.2, 0.9]}
    edge = [(5, 4, 0, 0, [0.501, 0.2], "new", None, 0.301)]
    actual = [(e, s, a, b, other.get((e, s, a), p), *rest) for e, s, a, b, p, *rest in sound] + [(5, 4, 0, 0, [0.4999, 0.2], "new", None, 0.2999)]
    return C.compare_updates(spark.createDataFrame(sound + edge, LOG), spark.createDataFrame(actual, LOG)).cache()


def rolled(df):
    return {(r["level"], r["task"], r["example_id"]): r for r in df.collect()}


def test_cases_tasks_and_the_whole(compared):
    cases = L.case_sums(compared, F.concat(F.lit("t"), F.col("example_id") % 2))
    rows = rolled(L.roll_up(cases))
    assert set(rows) == {("case", "t1", 1), ("case", "t0", 2), ("case", "t1", 5), ("task", "t0", None), ("task", "t1", None), ("all", None, None)}
    whole, bad, edge = rows["all", None, None], rows["case", "t0", 2], rows["case", "t1", 5]
    assert (whole["events"], whole["faulty_events"], whole["cases"], whole["faulty_cases"]) == (19, 2, 3, 1)
    assert (bad["first_step"], bad["faulty_events"]) == (2, 2) and "probability" in bad["first_reasons"] and "top_label" not in bad["first_reasons"]
    assert edge["faulty_events"] == 0 and edge["first_step"] is None and edge["categories"]["near_threshold"]["events"] == 1
    assert whole["max_probability_error"] == pytest.approx(0.7) and whole["mean_probability_error"] == pytest.approx((0.2 + 0.7 + 0.0011) / 19)
    categories = {(r["level"], r["task"], r["category"]): (r["events"], r["cases"]) for r in L.category_rows(L.roll_up(cases)).collect()}
    assert categories["all", None, "probability"] == (2, 1) and categories["task", "t0", "top_label"] == (1, 1) and ("task", "t1", "probability") not in categories


def test_portions_merge_to_the_whole(compared):
    task = F.concat(F.lit("t"), F.col("example_id") % 2)
    whole = rolled(L.roll_up(L.case_sums(compared, task)))
    parts = [L.case_sums(compared.where(F.col("step") == s), task) for s in (1, 2, 3, 4)]
    merged = rolled(L.roll_up(L.merge_cases(parts[::-1])))
    assert set(merged) == set(whole)
    for k, r in whole.items():
        for name, value in r.asDict(recursive=True).items():
            got = merged[k].asDict(recursive=True)[name]
            assert got == (pytest.approx(value) if isinstance(value, float) else value), (k, name)


def test_kinds_of_events_agree_without_another_join(compared):
    rows = {r["update_kind"]: r for r in C.agreement_matrix(compared).collect()}
    assert set(rows) == {"new"} and rows["new"]["rows"] == 19
    assert rows["new"]["label"] == pytest.approx(18 / 19) and rows["new"]["side"] == pytest.approx(17 / 19)
    assert rows["new"]["numbers"] == pytest.approx(sum(not set(r["differences"]) & {"cosine", "probability", "margin", "delta", "width"} for r in compared.collect()) / 19)
