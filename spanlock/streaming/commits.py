"""Commits as a stateful Structured Streaming query.

The state of a stream is its last step and its committed intervals, which never overlap; so it
grows with the commits and not with the events. Rows of one step of a stream must arrive in
one micro-batch. Rows of a step that is already closed are not dropped in silence: they come out
with phase ``late``, or with ``strict`` they end the query with an error.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from bisect import bisect_right
from collections.abc import Iterator
from functools import partial
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

READY = "example_id long, start_word long, end_word long, label string, step long, probability double, readiness double"
OUTPUT = "example_id long, start_word long, end_word long, label string, step long, readiness double, phase string"
STATE = "last_step long, start_words array<long>, end_words array<long>"


def _commit(key: tuple, batches: Iterator[Any], state: GroupState, strict: bool = False) -> Iterator[Any]:
    import numpy as np
    import pandas as pd

    last, starts, ends = state.get if state.exists else (0, [], [])
    starts, ends = list(starts), list(ends)  # in order, and apart from each other
    rows = pd.concat(list(batches), ignore_index=True)
    rows = rows.take(np.lexsort((*(rows[c].to_numpy() for c in ("label", "end_word", "start_word")), -rows["probability"].to_numpy(), -rows["readiness"].to_numpy(), rows["step"].to_numpy())))
    late = rows["step"].to_numpy() <= last
    if strict and late.any():
        raise ValueError(f"stream {key[0]}: step {rows['step'].iloc[0]} came after step {last}")
    kept = late.copy()
    for i, a, b in zip(np.flatnonzero(~late).tolist(), rows["start_word"].to_numpy()[~late].tolist(), rows["end_word"].to_numpy()[~late].tolist()):
        at = bisect_right(starts, b)  # the last that begins by the end of this one reaches furthest
        if not at or ends[at - 1] < a:
            starts.insert(at, a)
            ends.insert(at, b)
            kept[i] = True
    state.update((int(max(last, rows["step"].max())), starts, ends))
    out = rows[["example_id", "start_word", "end_word", "label", "step", "readiness"]].assign(phase=np.where(late, "late", "live"))
    yield out[kept]


def stream_commits(ready: DataFrame, *, strict: bool = False) -> DataFrame:
    """Commits of a streaming DataFrame of ready rows (``READY``), in append mode."""
    columns = [c.split()[0] for c in READY.split(", ")]
    return ready.select(*columns).groupBy("example_id").applyInPandasWithState(partial(_commit, strict=strict), OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, or a temporary one where that is unset and all runs on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = folder or tempfile.mkdtemp(prefix="spark-stream-")
    return f"{folder}/{uuid.uuid4().hex}"


def run_available(spark: SparkSession, source: str, target: str, checkpoint: str, files_per_batch: int | None = None, *, strict: bool = False) -> DataFrame:
    """Commits of all ready rows that lie in the folder ``source``, written to ``target``; a rerun goes on from the checkpoint."""
    reader = spark.readStream.schema(READY)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    query = stream_commits(reader.parquet(source), strict=strict).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(OUTPUT).parquet(target)
