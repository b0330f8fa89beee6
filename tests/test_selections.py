"""Stored selections."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from spanlock.sources import runs as R
from spanlock.sources import selections as L

PRESET = L.Preset("tiny", 2, 6)


def corpus(spark, n=120):
    return spark.createDataFrame([(f"u{i}", i, f"t{i % 2}", f"p{i // 3}", "xx", f"text {i}") for i in range(n)], "uid string, source_row_index long, task_name string, parent_id string, language string, text string")


def test_a_selection_is_stored_once_and_loads_whole(spark, tmp_path):
    rows, root = corpus(spark), str(tmp_path)
    assert L.store(spark, root, rows, PRESET, "s") == L.store(spark, root, rows.orderBy(F.desc("uid")), PRESET, "s") and len(list(tmp_path.iterdir())) == 1
    both = L.load(spark, root, rows, PRESET).collect()
    assert {(s, t): sum((r["split"], r["task_name"]) == (s, t) for r in both) for s in L.SPLITS for t in ("t0", "t1")} == {("dev", "t0"): 2, ("dev", "t1"): 2, ("test", "t0"): 6, ("test", "t1"): 6}
    by_split = {s: {(r["task_name"], r["parent_id"]) for r in both if r["split"] == s} for s in L.SPLITS}
    assert not by_split["dev"] & by_split["test"] and all(r["text"] == f"text {r['source_row_index']}" for r in both)
    words = L.vocabulary(spark.createDataFrame([("t0", "b"), ("t0", "a"), ("t0", "b"), ("t1", "c")], "task_name string, label string"))
    inputs = L.trace_inputs(L.load(spark, root, rows, PRESET, "test"), words).collect()
    assert len(inputs) == 12 and {r["task_name"]: r["labels"] for r in inputs} == {"t0": ["a", "b"], "t1": ["c"]}
    with pytest.raises(Exception, match="no labels for the task t1"):
        L.trace_inputs(L.load(spark, root, rows, PRESET), words.where("task_name = 't0'")).collect()


def test_what_a_load_refuses(spark, tmp_path):
    rows, root = corpus(spark), str(tmp_path)
    folder = R.folder_of(root, L.store(spark, root, rows, PRESET, "s"))
    some = L.load(spark, root, rows, PRESET).first()["source_row_index"]
    with pytest.raises(Exception, match="is missing in the corpus"):
        L.load(spark, root, rows.where(F.col("source_row_index") != some), PRESET).collect()
    with pytest.raises(Exception, match="is differs in the corpus"):
        L.load(spark, root, rows.withColumn("language", F.lit("yy")), PRESET).collect()
    with pytest.raises(L.SelectionError, match="quota"):  # another idea of the same preset
        L.load(spark, root, rows, L.Preset("tiny", 2, 7))
    with pytest.raises(R.IntegrityError, match="no run"):
        L.load(spark, root, rows, "smoke")
    spark.read.parquet(f"{folder}/rows").limit(1).coalesce(1).write.mode("append").parquet(f"{folder}/rows")
    with pytest.raises(R.IntegrityError, match="row count"):
        L.load(spark, root, rows, PRESET)


def test_presets_labels_and_short_tasks(spark, tmp_path):
    assert (L.preset_of("small").dev, L.preset_of("full").quota("test")) == (100, 1000)
    with pytest.raises(L.SelectionError, match="unknown preset"):
        L.preset_of("huge")
    with pytest.raises(L.SelectionError, match="fewer than"):
        L.store(spark, str(tmp_path), corpus(spark, 20), "smoke", "s")
    assert L.labels(["b", "a", "b"], repeats=True) == ("b", "a")
    for bad in ([], ["a", " "], ["a", "a"]):
        with pytest.raises(L.SelectionError):
            L.labels(bad)
    with pytest.raises(Exception, match="blank label in t0"):
        L.vocabulary(spark.createDataFrame([("t0", " ")], "task_name string, label string")).collect()
