"""Candidates tracked online: score events in, states, first ready rows and commits out.

The batch code works out what holds at a step from the whole log; this stateful query works it out from the
events so far and never revises it, so its output after any prefix of a stream is the batch result over that
prefix. The state of a stream is one entry for each candidate (last score, when, how many, the last changes, the average and
the run of each configuration that needs one, whether it was ready) and the words that each configuration has
committed. It grows with the spans of a stream and not with its events.

A step arrives whole in one micro-batch: its marker, a row without a span that says how many words are visible, and
its scores. Cached candidates age with every marker. Rows of a step that is closed already come out
with kind ``late``, or end a strict query with an error. A configuration that looks ahead cannot be tracked.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.specs import Spec

EVENT = "example_id long, step long, visible_word_count long, start_word long, end_word long, label string, probability double, label_margin double"
OUTPUT = "kind string, policy_id string, example_id long, start_word long, end_word long, label string, step long, probability double, readiness double, rescore_count long, snapshot_age long, tail_distance_words long"
_FIELDS = [c.split()[0] for c in OUTPUT.split(", ")]
#: ``candidates`` and ``taken`` are compressed Arrow batches: a row for each candidate, and for each word that a configuration has committed.
STATE = "last_step long, labels array<string>, candidates binary, taken binary"
#: The states of all streams lie on the executors' disks; however many they are, an executor holds only these buffers of them in memory.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "500",
}
ROLLING = 3


def events(steps: DataFrame, obs: DataFrame) -> DataFrame:
    """The rows that a tracker reads (``EVENT``): a marker for each step, and the scores."""
    columns = [c.split()[0] for c in EVENT.split(", ")]
    none = {c: F.lit(None) for c in columns[3:]}
    return obs.select(*columns).unionByName(steps.select("example_id", "step", "visible_word_count").withColumns(none))


def _packed(columns: dict[str, Any]) -> bytes:
    """Columns of equal length as one compressed Arrow batch."""
    import pyarrow as pa

    batch, sink = pa.RecordBatch.from_pydict(columns), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> dict[str, Any]:
    import numpy as np
    import pyarrow as pa

    table = pa.ipc.open_stream(pa.py_buffer(bytes(data))).read_all()
    return {name: np.array(table[name]) for name in table.column_names}


class _Tracker:
    """One stream: its candidates as parallel arrays, in the order in which they came."""

    def __init__(self, specs: list[Spec], state: tuple | None):
        import numpy as np

        self.np, self.specs, self.q = np, specs, [dict(s.parameters) for s in specs]
        self.last, self.labels, candidates, taken = state or (0, [], None, None)
        self.labels, self.code = list(self.labels), {label: i for i, label in enumerate(self.labels)}
        #: What a candidate begins with; a configuration has a run or an average only if it needs one.
        self.new = {"start": np.int64(0), "end": np.int64(0), "label": np.int32(0), "p": np.nan, "margin": 0.0, "scored": np.int64(0), "scores": np.int64(0)}
        if any(s.family == "stability-gate" for s in specs):
            self.new |= {f"change{i}": np.nan for i in range(ROLLING)}
        for c, s in enumerate(specs):
            self.new |= {f"ready{c}": np.False_} | ({f"run{c}": np.int64(0)} if s.family == "snapshot-patience" else {}) | ({f"average{c}": np.nan} if s.family == "ema" else {})
        self.of = {name: np.zeros(0, np.asarray(v).dtype) for name, v in self.new.items()} if candidates is None else _unpacked(candidates)
        self.taken: list[set[int]] = [set() for _ in specs]
        if taken is not None:
            words = _unpacked(taken)
            for c, mine in enumerate(self.taken):
                mine.update(words["word"][words["spec"] == c].tolist())
        self.at = {key: i for i, key in enumerate(zip(*(self.of[c].tolist() for c in ("start", "end", "label"))))}

    def state(self) -> tuple:
        np = self.np
        words = [np.array(sorted(mine), np.int64) for mine in self.taken]
        spec = np.repeat(np.arange(len(words), dtype=np.int32), [len(w) for w in words])
        return int(self.last), list(self.labels), _packed(self.of), _packed({"spec": spec, "word": np.concatenate([*words, np.zeros(0, np.int64)])})

    def observe(self, step: int, rows: list[tuple]) -> None:
        """New scores of a step: (start, end, label, probability, margin)."""
        np, of = self.np, self.of
        self.last = step
        if not rows:
            return
        start, end, names, now, margin = zip(*rows)
        for label in names:
            if label not in self.code:
                self.code[label] = len(self.labels)
                self.labels.append(label)
        keys = list(zip(start, end, (self.code[label] for label in names)))
        n = len(self.at)
        at = np.array([self.at.setdefault(key, len(self.at)) for key in keys])
        if len(self.at) > n:
            for name, v in self.new.items():
                of[name] = np.concatenate([of[name], np.full(len(self.at) - n, v, of[name].dtype)])
            of["start"][at], of["end"][at], of["label"][at] = start, end, [key[2] for key in keys]
        now, was = np.array(now, float), of["p"][at]
        if "change0" in of:
            for i in range(ROLLING - 1):
                of[f"change{i}"][at] = of[f"change{i + 1}"][at]
            of[f"change{ROLLING - 1}"][at] = now - was
        for c, q in enumerate(self.q):
            if f"average{c}" in of:
                of[f"average{c}"][at] = np.where(np.isnan(was), now, now * q["alpha"] + of[f"average{c}"][at] * (1 - q["alpha"]))
        of["p"][at], of["margin"][at], of["scored"][at] = now, margin, step
        of["scores"][at] += 1

    def by_name(self) -> Any:
        """For each candidate the place of its label among the labels in order."""
        place = {label: i for i, label in enumerate(sorted(self.labels))}
        return self.np.array([place[label] for label in self.labels], self.np.int32)[self.of["label"]]

    def extension(self) -> Any:
        """How much better a longer span of the same start and label is now; 0 for the longest."""
        np, start, end, label, p = self.np, *(self.of[c] for c in ("start", "end", "label", "p"))
        order = np.lexsort((-end, label, start))
        best = np.zeros(len(order))
        family, top = None, -np.inf
        for i, a, name, x in zip(order.tolist(), start[order].tolist(), label[order].tolist(), p[order].tolist()):
            if (a, name) != family:
                family, top = (a, name), -np.inf
            best[i] = top - x if top > -np.inf else 0.0
            top = max(top, x)
        return best

    def met(self, c: int, tail: Any, features: dict) -> tuple[Any, Any]:
        """(which candidates are ready for a configuration, their readiness)."""
        np, q, of, p = self.np, self.q[c], self.of, self.of["p"]
        family = self.specs[c].family
        if family == "snapshot-patience":
            of[f"run{c}"] = np.where(p >= q["threshold"], of[f"run{c}"] + 1, 0)
            return of[f"run{c}"] >= q["patience"], p
        if family == "ema":
            return of[f"average{c}"] >= q["threshold"], of[f"average{c}"]
        if family == "stability-gate":
            if "extension" not in features:
                changes = np.abs([of[f"change{i}"] for i in range(ROLLING)])
                features |= {"extension": self.extension(), "instability": np.where(np.isnan(changes), 0.0, changes).max(axis=0)}
            ok = (p >= q["tau"]) & (of["scores"] >= q["min_rescores"])
            ok &= ~np.bool_(q["use_instability"]) | (features["instability"] <= q["epsilon"])
            ok &= ~np.bool_(q["use_label_margin"]) | (of["margin"] >= q["min_label_margin"])
            return ok & (~np.bool_(q["use_extension"]) | (features["extension"] <= q["max_extension_advantage"])), p
        ok = p >= q["threshold"]
        if family == "fixed-lag":
            ok = ok & (tail >= q["lag_words"])
        if family == "rescore-patience":
            ok = ok & (of["scores"] >= q["patience"])
        return ok, p

    def states(self, example: int, step: int, visible: int, rows: Any = slice(None)) -> dict[str, Any]:
        """The states of a step, or some of them, by column."""
        np, of = self.np, {c: v[rows] for c, v in self.of.items() if c in ("start", "end", "label", "p", "scored", "scores")}
        n = len(of["start"])
        whole = {"example_id": np.full(n, example), "step": np.full(n, step)}
        return whole | {"start_word": of["start"], "end_word": of["end"], "label": np.array(self.labels, dtype=object)[of["label"]], "probability": of["p"], "rescore_count": of["scores"], "snapshot_age": step - of["scored"], "tail_distance_words": visible - 1 - of["end"]}

    def rows(self, example: int, step: int, visible: int) -> Iterator[dict[str, Any]]:
        """What a step brings beside its states, by column: candidates that are ready for the first time, and commits among those."""
        np, of, p = self.np, self.of, self.of["p"]
        features: dict = {}
        name = self.by_name()
        for c, spec in enumerate(self.specs):
            ok, score = self.met(c, visible - 1 - of["end"], features)
            new = np.flatnonzero(ok & ~of[f"ready{c}"])
            of[f"ready{c}"][new] = True
            new = new[np.lexsort((name[new], of["end"][new], of["start"][new], -p[new], -score[new]))]
            taken, won = self.taken[c], []
            for i, a, b in zip(new.tolist(), of["start"][new].tolist(), of["end"][new].tolist()):
                if taken.isdisjoint(range(a, b + 1)):
                    taken.update(range(a, b + 1))
                    won.append(i)
            for kind, which in (("ready", new), ("commit", np.array(won, np.int64))):
                if len(which):
                    yield {"kind": np.full(len(which), kind, object), "policy_id": np.full(len(which), spec.policy_id, object), "readiness": score[which]} | self.states(example, step, visible, which)


def _track(key: tuple, batches: Iterator[Any], state: GroupState, specs: list[Spec], states: bool, strict: bool) -> Iterator[Any]:
    import pandas as pd

    tracker = _Tracker(specs, state.get if state.exists else None)
    example, closed = int(key[0]), tracker.last
    frame = pd.concat(list(batches), ignore_index=True)
    late, held = frame[frame["step"] <= closed], []
    if strict and len(late):
        raise ValueError(f"stream {example}: step {late['step'].min()} came after step {closed}")
    whole = {c: "Int64" for c in ("start_word", "end_word", "rescore_count", "snapshot_age", "tail_distance_words")}
    if len(late):
        rows = late[["example_id", "start_word", "end_word", "label", "step", "probability"]].assign(kind="late", policy_id=None, readiness=float("nan"), rescore_count=None, snapshot_age=None, tail_distance_words=None)
        yield rows.astype(whole)[_FIELDS]
    for step, rows in frame[frame["step"] > closed].groupby("step"):
        scores = rows[rows["start_word"].notna()]
        tracker.observe(int(step), list(zip(scores["start_word"].astype("int64").tolist(), scores["end_word"].astype("int64").tolist(), scores["label"].tolist(), scores["probability"].tolist(), scores["label_margin"].tolist())))
        visible = int(rows["visible_word_count"].iloc[0])
        if states and len(tracker.at):
            part = {c: v.copy() for c, v in tracker.states(example, int(step), visible).items()}
            yield pd.DataFrame(part).assign(kind="state", policy_id=None, readiness=float("nan")).astype(whole)[_FIELDS]  # whole columns, one frame a step
        held.extend(tracker.rows(example, int(step), visible))
    state.update(tracker.state())
    if held:
        yield pd.DataFrame({c: tracker.np.concatenate([part[c] for part in held]) for c in _FIELDS}).astype(whole)


def track(rows: DataFrame, specs: list[Spec], *, states: bool = True, strict: bool = False) -> DataFrame:
    """States (if asked for), first ready rows and commits of a streaming DataFrame of events, in append mode."""
    ahead = [s.policy_id for s in specs if s.analysis_only]
    if ahead:
        raise ValueError(f"a stream cannot look ahead: {ahead}")
    return rows.groupBy("example_id").applyInPandasWithState(partial(_track, specs=specs, states=states, strict=strict), OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def run_available(spark: SparkSession, source: str, target: str, checkpoint: str, specs: list[Spec], *, files_per_batch: int | None = None, **options) -> DataFrame:
    """Tracks all events that lie in the folder ``source`` into ``target``; a rerun goes on from the checkpoint."""
    reader = spark.readStream.schema(EVENT)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    rows = track(reader.parquet(source), specs, **options)
    before = {name: spark.conf.get(name, None) for name in STORE}
    try:
        for name, value in STORE.items():
            spark.conf.set(name, value)
        query = rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    return spark.read.schema(OUTPUT).parquet(target)
