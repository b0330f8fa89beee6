"""State of the tracker: small for a candidate, and on disk for all streams together."""

from __future__ import annotations

from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from spanlock.operators import specs as G
from spanlock.plans import evaluations as E
from spanlock.streaming import tracker as T


def test_state_of_a_candidate_is_small_and_comes_back():
    rng, tracker = np.random.default_rng(1), T._Tracker(E.TRACKED, None)
    for step in (1, 2):
        spans = [(a, a + w, label, float(rng.random()), 0.5) for a in range(500) for w in range(3) for label in ("person", "place")]
        tracker.observe(step, spans[: 1500 * step])
        list(tracker.rows(1, step, 600))
    state = tracker.state()
    assert sum(len(part) for part in state if isinstance(part, bytes)) < 60 * len(tracker.at)  # 250 bytes as arrays of longs and doubles
    again = T._Tracker(E.TRACKED, state)
    assert again.at == tracker.at and again.taken == tracker.taken and again.labels == tracker.labels and again.last == 2
    assert all(np.array_equal(v, again.of[c], equal_nan=v.dtype == float) for c, v in tracker.of.items())


def test_state_of_all_streams_lies_on_disk_and_the_session_is_left_as_it_was(spark, tmp_path):
    spark.createDataFrame([(1, 1, 4, None, None, None, None, None), (1, 1, 4, 0, 0, "a", 0.9, 0.1)], T.EVENT).coalesce(1).write.parquet(str(tmp_path / "events"))
    rows = T.run_available(spark, str(tmp_path / "events"), str(tmp_path / "out"), str(tmp_path / "checkpoint"), [G.Spec("fixed-threshold", "main", (("threshold", 0.5),))])
    assert rows.where(F.col("kind") == "commit").count() == 1
    files = {p.suffix for p in Path(tmp_path / "checkpoint" / "state").rglob("*") if p.is_file() and not p.name.startswith(".")}
    assert ".changelog" in files and ".delta" not in files
    assert all(spark.conf.get(name, None) is None for name in T.STORE)
