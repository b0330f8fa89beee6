"""The whole grid from first steps against every policy by itself."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from spanlock.operators import evaluation as E
from spanlock.operators import metrics as M
from spanlock.operators import policies as P
from spanlock.operators import resolve as R
from spanlock.operators import specs as G
from spanlock.operators import sweep as X
from spanlock.operators import updates as U
from spanlock.plans import queries as Q
from spanlock.sources import tables

TEXT = "Ann Lee met Bob in Rome, and then Bob left for Oslo with Ann; nobody saw them until May in Bonn or Graz."


@pytest.fixture(scope="module")
def sized(spark):
    """Two short texts in chunks of four sizes; the window reaches back far, so that spans are scored often."""
    how = U.Scoring(right_context=9)
    texts = spark.createDataFrame([(1, TEXT), (2, "A b c d e f g."), (3, "")], "id long, text string")
    steps = U.with_word_counts(tables.chunk_conditions(texts, [1, 2, 4, 8])).cache()
    obs = U.observations(U.span_updates(U.hash_scorer(U.candidates(steps, how), how), how), how).cache()
    words = U.stream_words(steps).cache()
    return steps, obs, words, Q.gold_entities(words)


def plain(sized, specs):
    """Counts by the dense states, ready rows and the fold over them."""
    steps, obs, _, gold = sized
    ready = P.first_ready(G.ready(U.candidate_states(obs, steps), specs, look_ahead=True), ("policy_id",))
    committed = R.commits(ready, policy=("policy_id",)).join(gold.select(*P.KEY).distinct().withColumn("hit", F.lit(1)), P.KEY, "left").join(steps.select("example_id", "step", "visible_word_count"), ["example_id", "step"])
    rows = committed.groupBy("example_id", "policy_id").agg(F.count(F.lit(1)), F.count("hit"), F.sum("step"), F.sum(F.col("visible_word_count") - 1 - F.col("end_word")))
    return {tuple(r) for r in rows.collect()}


def sweep(sized, specs):
    steps, obs, words, gold = sized
    return {tuple(r) for r in X.commit_counts(obs, steps, words, gold, specs, look_ahead=True).collect()}


@pytest.mark.parametrize("family", sorted(G.AXES))
def test_all_configurations_of_a_family(sized, family):
    specs = [s for s in G.expand() if s.family == family]
    ours, theirs = sweep(sized, specs), plain(sized, specs)
    assert ours == theirs and len(ours) > len(specs)


def test_a_configuration_without_commits_is_a_row_of_zeros(spark, sized):
    specs = [G.Spec("fixed-threshold", "main", (("threshold", t),)) for t in (0.5, 2.0)]
    steps, obs, words, gold = sized
    counts = X.commit_counts(obs, steps, words, gold, specs, look_ahead=True).withColumn("size", F.substring_index("example_id", ":", 1))
    rows = X.totals(counts, G.frame(spark, specs), "size", ["1", "2", "4", "8"]).collect()
    assert len(rows) == 8 and {r["commits"] > 0 for r in rows if r["policy_id"] == specs[0].policy_id} == {True}
    assert {(r["commits"], r["correct"], r["steps"], r["context_words"]) for r in rows if r["policy_id"] == specs[1].policy_id} == {(0, 0, 0, 0)}


def test_sparse_states_carry_the_features_of_the_dense_ones(sized):
    steps, obs, _, _ = sized
    features = ["probability", "rescore_count", "instability", "label_margin", "extension_advantage"]
    sparse = P.gate_features(X.sparse_states(obs, steps), keep=("until",))
    dense = P.gate_features(U.candidate_states(obs, steps)).select(*P.KEY, "step", *features)
    spread = sparse.withColumn("step", F.explode(F.sequence("step", "until"))).select(*P.KEY, "step", *features)
    assert spread.count() == dense.count() and spread.exceptAll(dense).isEmpty()
    assert sparse.count() < dense.count()


def test_the_whole_table_in_one_exchange_of_rows(spark, sf_dir):
    from spanlock.plans import evaluations as E

    rows = E.grid_commit_counts(spark, sf_dir).toPandas()
    assert len(rows) == 4 * len(G.expand()) and rows.policy_id.nunique() == len(G.expand())
    assert (rows.correct <= rows.commits).all() and (rows.commits > 0).any() and (rows.commits == 0).any()
    threshold = next(s.policy_id for s in G.expand() if s.parameters == (("threshold", 0.8),))
    known = {r["chunk_words"]: r["commits"] for r in E.chunk_conditions(spark, sf_dir).collect()}
    assert dict(rows[rows.policy_id == threshold][["chunk_words", "commits"]].itertuples(index=False)) == known


def test_ready_rows_are_counted_without_states(sized):
    steps, obs, _, _ = sized
    specs = [s for s in G.expand() if s.family in ("fixed-threshold", "fixed-lag") and dict(s.parameters)["threshold"] in (0.1, 0.5, 0.9)]
    columns = ["policy_id", *P.KEY, "step", "probability", "readiness", "rows"]
    want = E.counted(G.ready(U.candidate_states(obs, steps), specs)).select(*columns).collect()
    assert sorted(map(tuple, E.counted_scores(obs, steps, specs).select(*columns).collect())) == sorted(map(tuple, want))
    with pytest.raises(ValueError):
        E.counted_scores(obs, steps, [s for s in G.expand() if s.family == "ema"])


def test_commits_carry_counts_of_first_rows(spark):
    first = spark.createDataFrame([("p", 1, 0, 1, "x", 1, 0.9, 0.9, 4), ("p", 1, 1, 2, "x", 1, 0.8, 0.8, 3), ("q", 1, 1, 2, "x", 1, 0.8, 0.8, 3)], "policy_id string, example_id long, start_word long, end_word long, label string, step long, probability double, readiness double, rows long")
    got = R.commits(first, policy=("policy_id",), keep=("rows",)).select("policy_id", "start_word", "rows").collect()
    assert sorted(map(tuple, got)) == [("p", 0, 4), ("q", 1, 3)]


def test_commit_rows_are_those_of_the_dense_states(sized):
    steps, obs, _, _ = sized
    columns = ["policy_id", *P.KEY, "step", "readiness"]
    states = U.candidate_states(obs, steps)
    specs = G.pilot(G.expand())
    got = X.commit_rows(obs, steps, specs, look_ahead=True).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, R.commits(G.ready(states, specs, look_ahead=True), policy=("policy_id",)).select(*columns).collect()))
    bounds = (0.4, 0.6, 0.05, 0.4, 2)
    got = X.commit_rows(obs, steps, list(G.gate_ablations(*bounds).values())).select(*columns).collect()
    want = R.commits(P.grid(P.gate_features(states), P.gate_ablations(*bounds)), policy=("policy_id",)).select(*columns).collect()
    assert want and sorted((r[0].split(":")[1], *r[1:]) for r in got) == sorted(map(tuple, want))


@pytest.mark.parametrize("widest, end", [(16, 100), (16, 2), (1, 100)])
def test_columns_resolved_side_by_side_are_those_of_one_pass_each(monkeypatch, widest, end):
    import numpy as np

    monkeypatch.setattr(X, "WIDEST", widest)
    monkeypatch.setattr(X, "ONE_BY_ONE", end)  # how early what is left goes one by one
    r = np.random.default_rng(7)
    s = X._Stream.__new__(X._Stream)
    lines = np.array([(a, b, label) for a in range(30) for b in range(a, min(a + 3, 30)) for label in range(1 + (a + b) % 3)])
    s.start, s.end, s.width, s.kind = lines[:, 0], lines[:, 1], 3, np.int32
    s.span, s.never = np.flatnonzero(np.r_[True, (np.diff(lines[:, :2], axis=0) != 0).any(axis=1)]), np.iinfo(np.int32).max
    keys = np.array([r.permutation(len(lines)) + 40 * lines[:, 1] * (c % 2) for c in range(20)], dtype=np.int32).T  # odd columns: later words come later
    keys = np.argsort(np.argsort(keys, axis=0, kind="stable"), axis=0).astype(np.int32)
    keys[r.random(keys.shape) < 0.3] = s.never
    keys[:, 3] = s.never
    column, key = s.free(keys)
    for c in range(20):
        taken, want = set(), []
        for i in np.argsort(keys[:, c], kind="stable"):
            words = set(range(s.start[i], s.end[i] + 1))
            if keys[i, c] < s.never and not words & taken:
                taken |= words
                want.append(keys[i, c])
        assert sorted(key[column == c]) == want


def test_levels_give_the_first_row_at_each_bound():
    import numpy as np

    value = np.array([[0.2, 0.7, 0.1, 0.9], [0.5, -np.inf, -np.inf, -np.inf]])
    assert X._reached(value, np.array([0.9, 0.5, 0.95, 0.1])).tolist() == [[3, 1, 4, 0], [4, 0, 4, 0]]


def test_the_grid_scores_spans_of_all_chunk_sizes_again(spark, sf_dir):
    from spanlock.plans import evaluations as E

    grid = E.grid_commit_counts(spark, sf_dir).toPandas()
    again = {s.policy_id for s in G.expand() if s.family == "rescore-patience" and s.parameters == (("patience", 2), ("threshold", 0.5))}
    commits = grid[grid.policy_id.isin(again)].set_index("chunk_words").commits
    assert (commits > 0).all() and set(commits.index) == {"1", "2", "4", "8"}
    threshold = next(s.policy_id for s in G.expand() if s.parameters == (("threshold", 0.8),))
    obs = E._sized(spark, sf_dir, how=U.Scoring())[2]
    want = {r["size"]: r["count"] for r in R.commits(P.fixed_threshold(obs, 0.8)).groupBy(F.substring_index("example_id", ":", 1).alias("size")).count().collect()}
    assert dict(grid[grid.policy_id == threshold][["chunk_words", "commits"]].itertuples(index=False)) == want


def test_commits_are_counted_in_the_task_of_their_stream(sized):
    steps, obs, words, _ = sized
    specs = [s for s in G.expand() if s.family in ("fixed-threshold", "fixed-lag") and dict(s.parameters)["threshold"] in (0.1, 0.5, 0.9)]
    ready = E.counted_scores(obs, steps, specs)
    got = X.counted_commits(obs, steps, words, specs).cache()
    columns = ["policy_id", *P.KEY, "step", "readiness", "rows"]
    want = R.commits(ready, policy=("policy_id",), keep=("rows",))
    assert sorted(map(tuple, got.where("start_word is not null").select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))
    assert {tuple(r) for r in got.where("start_word is null").select("policy_id", "example_id", "rows").collect()} == {tuple(r) for r in ready.groupBy("policy_id", "example_id").agg(F.sum("rows")).collect()}
    placed = Q.spans_in_chars(got.where("start_word is not null").drop("start_char", "end_char"), words).select(*columns, "start_char", "end_char")
    assert placed.exceptAll(got.select(*placed.columns)).isEmpty()
    with pytest.raises(ValueError):
        X.counted_commits(obs, steps, words, [s for s in G.expand() if s.family == "ema"])


def test_evaluation_writes_commits_and_not_ready_rows(spark, sf_dir, monkeypatch):
    from spanlock.plans import evaluations as plans

    monkeypatch.setattr(E, "counted_scores", None)
    plan = plans.evaluated(spark, sf_dir)[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "md5(" not in plan  # texts, words and gold are not worked out once more


def test_churn_counts_what_comes_and_goes_without_sets(spark):
    steps = spark.createDataFrame([(e, s) for e, n in ((1, 4), (2, 1), (3, 2)) for s in range(1, n + 1)], "example_id long, step long")
    rows = [(1, 1, 0), (1, 1, 3), (1, 2, 0), (1, 2, 0), (1, 4, 0), (1, 4, 5), (2, 1, 0)]
    snapshots = spark.createDataFrame([(e, s, a, a, "x") for e, s, a in rows], "example_id long, step long, start_word long, end_word long, label string")
    out = M.churn(snapshots, steps)
    assert {tuple(r) for r in out.collect()} == {(1, 1 + 1 + 2, 2 + 1 + 2), (3, 0, 0)}
    assert "array" not in out._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["policy_pareto", "matched_policies"])
def test_choices_among_policies_read_groups_that_are_worked_out_once(spark, sf_dir, name):
    assert "example_id" not in Q.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()


def test_observations_of_a_stream_follow_from_its_scored_spans(sized):
    _, obs, _, _ = sized
    import pyarrow as pa

    mine = obs.where("example_id = '1:1'").select(*X.SCORED)
    probs = F.transform(F.array_sort(F.collect_list(F.struct(F.col("label") == "place", "probability"))), lambda x: x["probability"])
    scores = mine.groupBy("example_id", "start_word", "end_word", "step").agg(probs.alias("probs")).orderBy(F.rand(3))
    got = X._observed(pa.table(scores.toArrow()), ["person", "place"]).to_pylist()
    assert sorted(tuple(r[c] for c in X.SCORED if c != "next_step") for r in got) == sorted(tuple(r[c] for c in X.SCORED if c != "next_step") for r in mine.collect())
    nexts = lambda rows: {(r["start_word"], r["end_word"], r["label"], r["step"]): r["next_step"] for r in rows}
    assert nexts(got) == nexts(mine.collect()) and None in nexts(got).values()


def test_streams_get_a_row_for_all_labels_of_a_span(spark, sf_dir, monkeypatch):
    from spanlock.plans import evaluations as plans

    monkeypatch.setattr(Q, "kept", lambda df: df)
    plan = plans.bootstrap_rows(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "probs" in plan and "instability" not in plan and "next_step" not in plan
