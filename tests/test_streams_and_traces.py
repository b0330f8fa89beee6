"""The streaming query, the edge buffer and checked trace folders."""

from __future__ import annotations

import os

import pytest

from spanlock.operators import buffer as B
from spanlock.operators import resolve as R
from spanlock.plans import queries as engine
from spanlock.sources import traces
from spanlock.streaming import commits as C

STATE = "example_id long, start_word long, end_word long, label string, step long, probability double, tail_distance_words long"


def test_stream_equals_batch_over_many_batches(spark, sf_dir, tmp_path):
    ready = engine._ready(engine.stream(spark, sf_dir), "fixed_threshold").cache()
    source = str(tmp_path / "ready")
    steps = sorted(r["step"] for r in ready.select("step").distinct().collect())
    for i, step in enumerate(steps):  # one file a step, older steps in older files
        ready.where(f"step = {step}").coalesce(1).write.mode("append").parquet(source)
        for f in os.listdir(source):
            if f.endswith(".parquet") and os.path.getmtime(f"{source}/{f}") > 1e9:
                os.utime(f"{source}/{f}", (1_000_000 + i, 1_000_000 + i))
    out = C.run_available(spark, source, str(tmp_path / "out"), str(tmp_path / "checkpoint"), files_per_batch=1)
    got = {tuple(r)[:6] for r in out.where("phase = 'live'").collect()}
    want = {tuple(r) for r in R.commits(ready).select("example_id", "start_word", "end_word", "label", "step", "readiness").collect()}
    assert got == want and len(steps) > 2
    assert out.where("phase = 'late'").isEmpty()


def test_late_rows_come_out_as_late(spark, tmp_path):
    source = str(tmp_path / "ready")
    for step, start in ((5, 0), (3, 9)):
        spark.createDataFrame([(1, start, start, "a", step, 0.9, 0.9)], C.READY).coalesce(1).write.mode("append").parquet(source)
        out = C.run_available(spark, source, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    assert {(r["start_word"], r["phase"]) for r in out.collect()} == {(0, "live"), (9, "late")}


def test_late_rows_end_a_strict_query(spark, tmp_path):
    source = str(tmp_path / "ready")
    run = lambda: C.run_available(spark, source, str(tmp_path / "out"), str(tmp_path / "checkpoint"), strict=True)
    spark.createDataFrame([(1, 0, 0, "a", 5, 0.9, 0.9)], C.READY).coalesce(1).write.mode("append").parquet(source)
    assert run().count() == 1
    spark.createDataFrame([(1, 9, 9, "a", 3, 0.9, 0.9)], C.READY).coalesce(1).write.mode("append").parquet(source)
    with pytest.raises(Exception, match="came after step 5"):
        run()


def buffered(spark, rows, **options):
    df = spark.createDataFrame(rows, STATE)
    return {(r["start_word"], r["end_word"], r["step"], r["phase"]) for r in B.edge_buffer(df, 0.8, **options).collect()}


def test_edge_buffer_waits_two_updates_and_extensions_do_not_wait_anew(spark):
    rows = [(1, 0, 0, "a", s, 0.9, s - 1) for s in (1, 2, 3, 4)] + [(1, 0, 1, "a", s, 0.95, s - 2) for s in (2, 3, 4)]
    assert buffered(spark, rows, close=False) == {(0, 0, 3, "live"), (0, 0, 4, "live"), (0, 1, 3, "live"), (0, 1, 4, "live")}


def test_edge_buffer_closes_at_the_end(spark):
    rows = [(1, 5, 5, "a", 2, 0.9, 0), (1, 0, 0, "a", 1, 0.2, 0), (1, 0, 0, "a", 2, 0.85, 3)]
    assert buffered(spark, rows) == {(5, 5, 2, "close"), (0, 0, 2, "live")}
    assert buffered(spark, rows, close=False) == {(0, 0, 2, "live")}


def test_block_reasons_name_the_blocker(spark):
    ready = spark.createDataFrame([(1, 0, 1, "a", 1, 0.9, 0.9), (1, 1, 2, "a", 1, 0.8, 0.8), (1, 1, 2, "a", 2, 0.99, 0.99), (1, 4, 4, "a", 2, 0.9, 0.9)], C.READY)
    got = {(r["start_word"], r["step"], r["reason"], r["blocker_start"], r["blocker_step"]) for r in R.block_reasons(ready, R.commits(ready)).collect()}
    assert got == {(1, 1, "ready_overlap", 0, 1), (1, 2, "committed_overlap", 0, 1)}


def test_runs_are_read_back_and_tampering_is_found(spark, sf_dir, tmp_path):
    s = engine.stream(spark, sf_dir)
    folder = str(tmp_path / "run")
    traces.write_run({"steps": s.steps, "updates": s.updates}, folder)
    tables = traces.read_run(spark, folder)
    assert tables["updates"].count() == s.updates.count()
    assert traces.violations(tables["steps"], tables["updates"]).isEmpty()
    tables["steps"].limit(1).write.mode("append").parquet(f"{folder}/steps")
    with pytest.raises(ValueError):
        traces.read_run(spark, folder)


def test_violations_read_the_log_once(spark, sf_dir):
    ran = engine.QUERIES["trace_violations"](spark, sf_dir)._jdf.queryExecution()
    plan = ran.optimizedPlan().toString()
    assert plan.count("md5(") == 2 and plan.count("Join") == 1  # one score for each label, one look at the steps
    assert "BroadcastHashJoin" not in ran.executedPlan().toString()


def test_violations_count_rows_and_steps_that_are_there_twice(spark):
    steps = spark.createDataFrame([(1, 1, "a ", 2, 1), (1, 2, "b ", 4, None), (1, 2, "b ", 4, 2)], "example_id long, step long, chunk string, visible_char_count long, visible_word_count long")
    events = [(1, 1, 0, 0, [0.5]), (1, 1, 2, 1, [0.5]), (1, 1, 2, 1, [2.0]), (1, 2, 5, 5, [None]), (1, 9, 0, 0, None), (None, 1, 0, 0, [0.1])]
    got = traces.violations(steps, spark.createDataFrame(events, "example_id long, step long, start_word long, end_word long, probs array<double>")).groupBy("rule", "step").count()
    want = {("step_gap", 2): 1, ("chunk_length", 2): 1, ("word_order", 1): 2, ("unseen_word", 1): 2, ("probability", 1): 1, ("scored_twice", 1): 1, ("unknown_step", 1): 1, ("unknown_step", 9): 1}
    want |= {("unknown_step", 2): 1, ("unseen_word", 2): 1, ("probability", 2): 2}
    assert {(r["rule"], r["step"]): r["count"] for r in got.collect()} == want


def test_violations_are_named(spark):
    steps = spark.createDataFrame([(1, 1, "ab ", 3, 1), (1, 3, "c", 5, 2), (1, 4, "", 4, 2)], "example_id long, step long, chunk string, visible_char_count long, visible_word_count long")
    updates = spark.createDataFrame([(1, 1, 0, 5, [0.5]), (1, 3, 1, 0, [1.5]), (1, 3, 1, 0, [0.1]), (1, 9, 0, 0, [0.1])], "example_id long, step long, start_word long, end_word long, probs array<double>")
    got = {(r["rule"], r["step"]) for r in traces.violations(steps, updates).collect()}
    assert got == {("step_gap", 3), ("step_gap", 4), ("text_shrinks", 4), ("chunk_length", 3), ("chunk_length", 4), ("unseen_word", 1), ("word_order", 3), ("probability", 3), ("scored_twice", 3), ("unknown_step", 9)}


def test_sweeps_go_on_where_they_stopped(spark, tmp_path):
    from spanlock.sources import manifest as N

    ran = []

    def evaluate(keys):
        if len(ran) == 2 and not ran[-1:] == ["again"]:
            raise RuntimeError("the machine is gone")
        ran.append(keys)
        return spark.createDataFrame([(k, len(k)) for k in keys], "policy_id string, n int")

    keys = [f"p{i}" for i in range(10)]
    with pytest.raises(RuntimeError):
        N.sweep(spark, str(tmp_path / "s"), keys, evaluate, batch=3)
    ran.append("again")
    assert {r["policy_id"] for r in N.sweep(spark, str(tmp_path / "s"), keys, lambda k: (ran.append(k), spark.createDataFrame([(x, len(x)) for x in k], "policy_id string, n int"))[1], batch=3).collect()} == set(keys)
    assert len(ran) == 5  # two batches before, two after, none twice
    path = next((tmp_path / "s" / "results").iterdir())
    spark.createDataFrame([("x", 1)], "policy_id string, n int").write.mode("append").parquet(str(path))
    with pytest.raises(ValueError, match="differ from their note"):
        N.sweep(spark, str(tmp_path / "s"), keys, evaluate, batch=3)


def test_conditions_are_found_once(spark, tmp_path):
    from spanlock.sources import manifest as N

    rows = [("a", "dev", 1), ("b", "dev", 2), ("c", "test", 1), ("d", "dev", 4), ("e", "dev", 4)]
    spark.createDataFrame(rows, "run_id string, split string, chunk_words int").write.partitionBy("split", "chunk_words").parquet(str(tmp_path / "runs"))
    runs = spark.read.parquet(str(tmp_path / "runs"))
    assert {r["run_id"] for r in N.conditions(runs, split="dev", sizes=[1, 2]).collect()} == {"a", "b"}
    for sizes in ([4], [8]):
        with pytest.raises(ValueError):
            N.conditions(runs, split="dev", sizes=sizes)


def test_content_is_refused_in_reports(spark):
    from spanlock.sources import manifest as N

    with pytest.raises(ValueError, match="text"):
        N.without_content(spark.createDataFrame([(1, [("x", 1)])], "id long, rows array<struct<text:string,n:int>>"))
