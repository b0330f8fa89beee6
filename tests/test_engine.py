"""Small hand-made cases of the engine's operators."""

from __future__ import annotations

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanlock.functions import text as tx
from spanlock.operators import metrics as M
from spanlock.operators import policies as P
from spanlock.operators import resolve as R
from spanlock.operators import selection as S
from spanlock.operators import sweep as X

STATE = "example_id long, start_word long, end_word long, label string, step long, probability double, rescore_count long, was_rescored boolean, tail_distance_words long"


def states(spark, scores, rescored=None, start=0, end=0, label="a"):
    """One candidate whose probability at step i + 1 is scores[i]."""
    rescored = rescored or [True] * len(scores)
    rows, n = [], 0
    for i, p in enumerate(scores):
        n += rescored[i]
        rows.append((1, start, end, label, i + 1, float(p), n, rescored[i], i))
    return spark.createDataFrame(rows, STATE)


def steps_of(df):
    return sorted(r["step"] for r in df.collect())


@given(st.text(alphabet=" \t\nab-_.é1", max_size=30), st.integers(1, 4))
@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_chunks_join_to_the_text(spark, text, n):
    df = spark.createDataFrame([(1, text)], "id long, text string")
    rows = sorted(tx.chunks(df, ["id"], "text", n).collect(), key=lambda r: r["step"])
    assert "".join(r["chunk"] for r in rows) == text
    assert all(len(re.findall(r"\S+", r["chunk"])) <= n for r in rows)


def test_tokens_have_exact_offsets(spark):
    text = "  Ana-Maria_x paid 3.50, ok?"
    rows = tx.tokens(spark.createDataFrame([(1, text)], "id long, text string"), ["id"], "text", tx.WORD).collect()
    assert [text[r["start_char"] : r["end_char"]] for r in rows] == [r["token"] for r in rows]
    assert [r["token"] for r in sorted(rows, key=lambda r: r["token_index"])] == ["Ana-Maria_x", "paid", "3", ".", "50", ",", "ok", "?"]


def test_threshold_includes_equality(spark):
    assert steps_of(P.fixed_threshold(states(spark, [0.7, 0.8, 0.9]), 0.8)) == [2, 3]


def test_lag_waits_for_context(spark):
    assert steps_of(P.fixed_lag(states(spark, [0.9, 0.9, 0.9]), 0.8, 2)) == [3]


def test_snapshot_patience_starts_again_after_a_fall(spark):
    assert steps_of(P.snapshot_patience(states(spark, [0.9, 0.1, 0.9, 0.9, 0.9]), 0.8, 2)) == [4, 5]


def test_rescore_patience_ignores_cached_steps(spark):
    s = states(spark, [0.9, 0.9, 0.9], rescored=[True, False, True])
    assert steps_of(P.rescore_patience(s, 0.8, 2)) == [3]


def test_ema_is_the_recurrence(spark):
    scores, rescored = [0.2, 0.9, 0.9, 0.9], [True, True, False, True]
    rows = {r["step"]: r["readiness"] for r in P.ema(states(spark, scores, rescored), 0.0, 0.5).collect()}
    assert rows[1] == pytest.approx(0.2)
    assert rows[2] == pytest.approx(0.55)
    assert rows[3] == pytest.approx(0.55)
    assert rows[4] == pytest.approx(0.725)


def test_a_policy_that_looks_ahead_must_be_allowed(spark):
    from spanlock.operators import specs as G

    s = states(spark, [0.9, 0.5, 0.9])
    ahead = [x for x in G.expand() if x.analysis_only]
    for call in (lambda: P.oracle_stable(s, 0.8), lambda: G.ready(s, ahead), lambda: X.commit_counts(s, s, s, s, ahead)):
        with pytest.raises(ValueError, match="look ahead"):
            call()


def test_oracle_needs_no_later_fall(spark):
    assert steps_of(P.oracle_stable(states(spark, [0.9, 0.5, 0.9, 0.9]), 0.8, look_ahead=True)) == [3, 4]


def test_commits_are_permanent_and_flat(spark):
    early = P.fixed_threshold(states(spark, [0.8, 0.8], start=0, end=1), 0.8)
    late = P.fixed_threshold(states(spark, [0.1, 0.99], start=1, end=2), 0.8)
    other = P.fixed_threshold(states(spark, [0.1, 0.85], start=3, end=3), 0.8)
    ready = early.unionByName(late).unionByName(other)
    assert {(r["start_word"], r["end_word"]) for r in R.commits(ready).collect()} == {(0, 1), (3, 3)}
    assert R.commits(ready, flat=False).count() == 3
    assert R.blocked_revisions(ready, R.commits(ready)).first()["blocked_revisions"] == 1


def test_interval_union_merges_adjacent(spark):
    df = spark.createDataFrame([(1, 0, 3), (1, 3, 5), (1, 7, 9), (1, 8, 8)], "example_id long, start_char long, end_char long")
    assert {(r["start_char"], r["end_char"]) for r in M.merge_intervals(df, ["example_id"]).collect()} == {(0, 5), (7, 9)}


def test_scores_of_nothing_are_zero(spark):
    counts = spark.createDataFrame([("t", 0, 0, 0)], "task string, tp long, fp long, fn long")
    assert all(r["f1"] == 0.0 for r in M.task_scores(counts).collect())


def test_pareto_keeps_equal_rows_and_agrees_with_the_anti_join(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (2, 1.0, 5.0), (3, 2.0, 2.0), (4, 3.0, 2.0), (5, 4.0, 1.0)], "id int, x double, y double")
    front = {r["id"] for r in S.pareto_2d(df, "x", "y").collect()}
    assert front == {1, 2, 3, 5}
    assert front == {r["id"] for r in S.pareto(df, ["x", "y"]).collect()}


def test_constrained_best_falls_back(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.9), ("b", 3, 0.1)], "k string, id int, v double")
    best = S.constrained_best(df, ["k"], F.col("v") >= 0.8, [F.col("id")])
    assert {(r["k"], r["id"]) for r in best.collect()} == {("a", 2), ("b", 3)}


def test_bootstrap_is_seeded_and_brackets_the_difference(spark):
    rows = [("t", f"p{i}", float(i % 3), 3.0, float(i % 2), 2.0) for i in range(40)]
    df = spark.createDataFrame(rows, "task string, parent string, a double, b double, c double, d double")
    run = lambda: S.paired_bootstrap(df, "task", "parent", ("a", "b"), ("c", "d"), replicates=200).first()
    one, two = run(), run()
    assert one == two
    assert one["lower"] <= one["difference"] <= one["upper"]


def test_balanced_sample_reaches_its_quota_in_a_hot_stratum(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") < 990, "hot").otherwise("cold").alias("s"))
    rows = S.balanced_sample(df, "s", F.sha2(F.col("id").cast("string"), 256), "id", 20)
    assert {r["s"]: r["count"] for r in rows.groupBy("s").count().collect()} == {"hot": 20, "cold": 10}


def test_the_grid_is_each_policy_by_itself(spark, sf_dir):
    from spanlock.operators import specs as G
    from spanlock.plans import queries as engine

    s = engine.stream(spark, sf_dir).states.where("example_id < 3").cache()
    chosen = [x for i, x in enumerate(G.expand()) if i % 97 == 0] + G.pilot(G.expand())
    chosen = list({x.policy_id: x for x in chosen}.values())
    got = {}
    for r in P.first_ready(G.ready(s, chosen, look_ahead=True), ("policy_id",)).collect():
        got.setdefault(r["policy_id"], {})[tuple(r[k] for k in P.KEY)] = (r["step"], round(r["readiness"], 9))
    for x in chosen:
        q = dict(x.parameters)
        rows = {
            "fixed-threshold": lambda: P.fixed_threshold(s, q["threshold"]),
            "fixed-lag": lambda: P.fixed_lag(s, q["threshold"], q["lag_words"]),
            "snapshot-patience": lambda: P.snapshot_patience(s, q["threshold"], q["patience"]),
            "rescore-patience": lambda: P.rescore_patience(s, q["threshold"], q["patience"]),
            "ema": lambda: P.ema(s, q["threshold"], q["alpha"]),
            "oracle-stable": lambda: P.oracle_stable(s, q["threshold"], look_ahead=True),
            "stability-gate": lambda: P.stability_gate(
                P.gate_features(s),
                q["tau"],
                min_rescores=q["min_rescores"],
                epsilon=q["epsilon"] if q["use_instability"] else None,
                min_margin=q["min_label_margin"] if q["use_label_margin"] else None,
                max_extension=q["max_extension_advantage"] if q["use_extension"] else None,
            ),
        }[x.family]()
        want = {tuple(r[k] for k in P.KEY): (r["step"], round(r["readiness"], 9)) for r in P.first_ready(rows).collect()}
        assert got.get(x.policy_id, {}) == want, x


def test_specs_are_read_back_by_their_id(spark):
    from spanlock.operators import specs as G

    rows = G.frame(spark, G.expand()).collect()
    assert len(rows) == 1396 and [G.from_row(r) for r in rows] == G.expand()
    with pytest.raises(ValueError):
        G.from_row({**rows[0].asDict(), "variant": "other"})
    assert len(G.pilot(G.expand())) == 10


def test_fronts_by_ranges_and_blocks_are_brute_force(spark):
    import random

    r = random.Random(7)
    rows = [(i, round(r.random(), 2), round(r.random(), 2), round(r.random(), 1)) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, x double, y double, z double").repartition(5)
    two = {a[0] for a in rows if not any(b[1] <= a[1] and b[2] <= a[2] and b[1:3] != a[1:3] for b in rows)}
    assert {x["id"] for x in S.pareto_2d(df, "x", "y").collect()} == two
    three = {a[0] for a in rows if not any(b[1] <= a[1] and b[2] <= a[2] and b[3] >= a[3] and b[1:] != a[1:] for b in rows)}
    assert {x["id"] for x in S.pareto(df, ["x", "y"], ["z"], block=64).collect()} == three


def test_samples_keep_parents_apart_and_fail_when_short(spark):
    df = spark.range(400).select("id", (F.col("id") % 2).alias("s"), (F.col("id") / 4).cast("int").cast("string").alias("parent"))
    draw = lambda split, quota: S.parent_disjoint_sample(df, "s", F.col("parent"), F.sha2(F.col("id").cast("string"), 256), "id", quota, split, dev_percent=50)
    dev, test = ({r["parent"] for r in draw(split, 30).collect()} for split in ("dev", "test"))
    assert dev and test and not dev & test
    with pytest.raises(ValueError):
        draw("dev", 300)


def test_offsets_that_are_no_word_boundary(spark):
    from spanlock.operators import spans as W

    words = spark.createDataFrame([(1, 0, 0, 3), (1, 1, 4, 8), (1, 2, 9, 12)], "example_id long, word_index long, start_char long, end_char long")
    gold = spark.createDataFrame([(1, 0, 8), (1, 4, 7), (1, 0, 20), (1, 3, 4), (2, 0, 1)], "example_id long, start_char long, end_char long")
    assert {(r[0], r[1], r[2], r["end_word"]) for r in W.gold_end_words(gold, words).collect()} == {(1, 0, 8, 1), (1, 4, 7, 1), (1, 0, 20, None), (1, 3, 4, None), (2, 0, 1, None)}
    assert {(r["start_char"], r["end_char"]): (r["start_word"], r["end_word"]) for r in W.chars_to_words(gold.where("example_id = 1"), words).collect()} == {(0, 8): (0, 1), (4, 7): (1, None), (0, 20): (0, None), (3, 4): (None, None)}


def test_masking_is_counted_by_characters(spark):
    """The published example: 5 of 8 masked characters are gold, 6 are gold, 9 of 15 are none."""
    span = "example_id long, start_char long, end_char long"
    predicted = spark.createDataFrame([(1, 0, 2), (1, 2, 4), (1, 8, 12)], span)
    gold = spark.createDataFrame([(1, 1, 5), (1, 10, 12)], span)
    rows = M.masking_counts(predicted, gold, spark.createDataFrame([(1, 15), (2, 4)], "example_id long, text_length long"))
    assert {tuple(r) for r in rows.select("example_id", "tp_chars", "predicted_chars", "gold_chars", "non_pii_chars").collect()} == {(1, 5, 8, 6, 9), (2, 0, 0, 0, 4)}
    assert rows.select(*M.masking_rates()).where("masking_fpr > 0").first()["masking_fpr"] == pytest.approx(1 / 3)


def test_corpus_is_read_strictly(spark, tmp_path):
    from spanlock.sources import tables

    good = '{"uid":"a","task_name":"t","source_dataset":"s","source_uid":"u","parent_id":"p","sentence_index":0,"text":"Ana met Bo","entities":[{"start":0,"end":3,"label":"person"}],"language":"en"}'
    path = tmp_path / "c.jsonl"
    path.write_text(good + "\n" + good.replace('"t"', '"other"').replace('"end":3', '"end":30') + "\n")
    rows = tables.read_corpus(spark, str(path))
    assert rows.count() == 2 and tables.read_corpus(spark, str(path), ["t"]).count() == 1
    assert [tuple(r) for r in tables.corpus_violations(rows).collect()] == [("a", "entity_offsets")]
    path.write_text(good + "\nnot json\n")
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed"):
        tables.read_corpus(spark, str(path)).collect()
