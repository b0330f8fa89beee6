"""Commits of every configuration of a grid, from first ready steps instead of ready rows.

Readiness of a configuration can change only where the span, or a longer one that begins at the same word, is scored;
in between it changes only by the age of a score, which is arithmetic on the step. So the dense states are not
made: observations go to the task of their stream as they are, ``_sparse`` makes a row of each of those events there, with how long it lasts, and
the stream gives the step at which a word came. For each stream, every family turns the
running maximum of what its threshold bounds (probability, average, run length) into a first step for each of its
configurations, a table of candidates by configurations. Its columns are resolved side by side: all spans that
come before whatever shares a word with them are committed in one round, for all configurations. What leaves a task is one row for each stream and configuration, so neither states nor ready
rows are multiplied by the size of the grid. A stream is the unit that must fit a task.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .policies import KEY, allow_look_ahead
from .specs import Spec

COUNTS = "example_id {kind}, policy_id string, commits long, correct long, steps long, context_words long"
ROWS = "policy_id string, example_id {kind}, start_word long, end_word long, label string, step long, readiness double"
COUNTED = "policy_id string, example_id {kind}, start_word long, end_word long, label string, step long, readiness double, rows long, start_char long, end_char long"
#: What is read of an observation.
SCORED = [*KEY, "step", "next_step", "probability", "rescore_count", "instability", "label_margin"]
#: No step: larger than any.
NEVER = np.iinfo(np.int32).max


def sparse_states(obs: DataFrame, steps: DataFrame) -> DataFrame:
    """States at the steps where the span or one of its family is scored, with ``until``, the last step of each.

    Columns are those that ``gate_features`` reads and keeps. A score is carried to the events of its family before the span's next
    score: a slice of the family's few steps, which a row gets by family.
    """
    family = ["example_id", "start_word", "label"]
    events = obs.groupBy(*family).agg(F.array_sort(F.collect_set("step")).alias("at"))
    last = steps.groupBy("example_id").agg(F.max("step").alias("last_step"))
    rows = obs.select(*KEY, F.col("step").alias("scored"), "next_step", "probability", "rescore_count", "instability", "label_margin").join(events, family).join(last, "example_id")
    inside = F.filter("at", lambda s: (s >= F.col("scored")) & (F.col("next_step").isNull() | (s < F.col("next_step"))))
    later = F.get("inside", F.col("i") + 1)
    rows = rows.withColumn("inside", inside).select("*", F.posexplode("inside").alias("i", "step"))
    return rows.select(
        *KEY,
        "step",
        F.coalesce(later - 1, F.col("next_step") - 1, "last_step").alias("until"),
        "probability",
        "rescore_count",
        "instability",
        "label_margin",
        (F.col("step") == F.col("scored")).alias("was_rescored"),
        F.lit(0).cast("long").alias("tail_distance_words"),
    )


def _coded(labels: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(labels in order, the place of each row's label among them)."""
    coded = labels.combine_chunks().dictionary_encode()
    names = np.array(coded.dictionary.to_pylist(), dtype=object)
    return np.sort(names), np.argsort(np.argsort(names))[coded.indices.to_numpy()]


def _observed(scores: pa.Table, labels: list[str], rolling: int = 3) -> pa.Table:
    """The observations (``SCORED``) of one stream from its scored spans, which have one probability for each label."""
    get = lambda name: scores[name].to_numpy()
    order = np.lexsort((get("step"), get("end_word"), get("start_word")))
    start, end, step = (get(c)[order] for c in ("start_word", "end_word", "step"))
    p = scores["probs"].combine_chunks().flatten().to_numpy().reshape(-1, len(labels))[order]
    new = np.r_[True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])]
    count = np.arange(len(start)) - np.flatnonzero(new)[np.cumsum(new) - 1] + 1
    last = np.r_[new[1:], True]
    change = np.abs(np.diff(p, axis=0, prepend=p[:1]))
    change[new] = 0.0
    instability = change.copy()
    for back in range(1, rolling):  # a score that has no such change has no earlier one either
        known = np.flatnonzero(count > back + 1)
        instability[known] = np.maximum(instability[known], change[known - back])
    ranked = np.sort(p, axis=1)
    margin = ranked[:, -1] - (ranked[:, -2] if len(labels) > 1 else 0.0)
    each = lambda x: np.repeat(x, len(labels))
    names = pa.DictionaryArray.from_arrays(np.tile(np.arange(len(labels), dtype=np.int32), len(p)), pa.array(labels))
    following = pa.array(each(np.r_[step[1:], 0]), mask=each(last))
    columns = [scores["example_id"].take(pa.array(each(order))), each(start), each(end), names, each(step), following, p.ravel(), each(count), instability.ravel(), each(margin)]
    return pa.table(dict(zip(SCORED, columns)))


def _sparse(rows: pa.Table, last: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """(columns, labels): ``sparse_states`` of one stream with its gate features, from its observations.

    ``until`` is the last step for which a row holds, ``label`` a place in ``labels``, which are in order. A score is carried to the events of its
    family before the span's next score, a slice of the family's steps in order.
    """
    get = lambda name: rows[name].to_numpy()
    names, code = _coded(rows["label"])
    start, end, scored, p, width = get("start_word"), get("end_word"), get("step"), get("probability"), last + 2
    stop = pc.fill_null(rows["next_step"], last + 1).to_numpy()
    family = (start * len(names) + code) * width
    events = np.unique(family + scored)
    low, high = np.searchsorted(events, family + scored), np.searchsorted(events, family + stop)
    n = high - low
    row = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + low[row]
    step, p = events[at] % width, p[row]
    later = events[np.minimum(at + 1, len(events) - 1)] % width
    order = np.lexsort((-end[row], at))  # the longest of a family at a step comes first
    group, ranked, longer = at[order], p[order], np.full(len(row), -np.inf)
    for k in range(1, len(row)):
        same = group[k:] == group[:-k]
        if not same.any():
            break
        longer[k:] = np.where(same, np.maximum(longer[k:], ranked[:-k]), longer[k:])
    extension = np.empty(len(row))
    extension[order] = np.where(longer > -np.inf, longer - ranked, 0.0)
    carried = {c: get(c)[row] for c in ("rescore_count", "instability", "label_margin")}
    columns = {"start_word": start[row], "end_word": end[row], "label": code[row], "step": step, "until": np.where(at + 1 < high[row], later, stop[row]) - 1, "probability": p, "was_rescored": step == scored[row], "extension_advantage": extension}
    return columns | carried, names


def _reached(value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Per candidate and bound how many rows come before the running maximum of ``value`` (-inf: no row) reaches it; all, if it never does.

    The bounds cut the maximum into levels, and the rows of each level are counted; no table of rows by bounds is made.
    """
    order = np.argsort(bounds, kind="stable")
    level = np.searchsorted(bounds[order], np.maximum.accumulate(value, axis=1), side="right")
    n = len(bounds) + 1
    counts = np.bincount((level + np.arange(len(value))[:, None] * n).ravel(), minlength=len(value) * n).reshape(-1, n)
    out = np.empty((len(value), n - 1), dtype=np.int64)
    out[:, order] = np.cumsum(counts, axis=1)[:, :-1]
    return out


#: The widest span for which words are looked at side by side; wider ones are taken one by one.
WIDEST = 16
#: Configurations of a gate that are resolved at a time.
AT_ONCE = 48
#: Rounds over all words end when so small a part of the spans is undecided.
ONE_BY_ONE = 100


class _Lines:
    """Candidates of a stream, one line each in the order of start, end and label, and what is committed of them."""

    def __init__(self, start: np.ndarray, end: np.ndarray, label: np.ndarray, names: np.ndarray, last: int):
        """From rows in that order; ``label`` is a place in ``names``."""
        moved = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
        new = np.r_[True, moved | (label[1:] != label[:-1])]
        self.line, self.base = np.cumsum(new) - 1, np.flatnonzero(new)
        self.start, self.end, self.label = start[new], end[new], names[label[new]]
        self.span = np.flatnonzero(np.r_[True, moved][new])  # the first line of each span
        self.width = int((self.end - self.start).max()) + 1
        self.kind = np.int32 if (last + 2) * len(self.line) < np.iinfo(np.int32).max else np.int64
        self.never = np.iinfo(self.kind).max

    def free(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(column, key) of what is committed in each column: keys (lines, columns), the smallest first, if its words are free.

        What is smaller than all that share a word with it is committed whatever comes before, and what it meets is out; that is
        repeated for all spans and columns side by side, and what few are left are taken one by one. Of the labels of a span only the best can be committed.
        """
        never, columns, out = self.never, np.arange(keys.shape[1]), []
        alike = len(keys) // len(self.span)
        if np.array_equal(self.span, np.arange(0, len(keys), alike)):  # as many labels for each span
            spans = keys[::alike].copy()
            for i in range(1, alike):
                np.minimum(spans, keys[i::alike], out=spans)
        else:
            spans = np.minimum.reduceat(keys, self.span, axis=0)
        start, end = self.start[self.span], self.end[self.span]
        if self.width > WIDEST:
            where = np.nonzero(spans < never)
            out.append(_one_by_one(where[1], spans[where], start[where[0]], end[where[0]]))
            return out[0]
        words, width, tables = int(end.max()) + 1, end - start + 1, {}
        for k in sorted(set(width.tolist())):
            tables[k] = np.full((words - k + 1, len(columns)), never, dtype=keys.dtype)
            tables[k][start[width == k]] = spans[width == k]
        many = True
        while many:
            best = np.full((words, len(columns)), never, dtype=keys.dtype)
            for k, a in tables.items():
                for o in range(k):
                    np.minimum(best[o : o + len(a)], a, out=best[o : o + len(a)])
            taken, left = np.zeros(best.shape, dtype=bool), np.zeros(len(columns), dtype=np.int64)
            for k, a in tables.items():
                around = best[: len(a)]
                for o in range(1, k):
                    around = np.minimum(around, best[o : o + len(a)])
                won = (a == around) & (a < never)
                where = np.nonzero(won)
                out.append((columns[where[1]], a[where]))
                for o in range(k):
                    taken[o : o + len(a)] |= won
            for k, a in tables.items():
                blocked = taken[: len(a)]
                for o in range(1, k):
                    blocked = blocked | taken[o : o + len(a)]
                np.copyto(a, never, where=blocked)
                left += (a < never).sum(axis=0)
            many = left.sum() > spans.size // ONE_BY_ONE
            if (left == 0).any():
                tables, columns = {k: a[:, left > 0] for k, a in tables.items()}, columns[left > 0]
        for where, a, k in [(np.nonzero(a < never), a, k) for k, a in tables.items()]:
            out.append((columns[where[1]], a[where], where[0], where[0] + k - 1))
        rest = [np.concatenate(x) for x in zip(*out[-len(tables) :])]
        return tuple(np.concatenate(x) for x in zip(*out[: -len(tables)], _one_by_one(*rest)))


class _Stream(_Lines):
    """All that is known of the candidates of a stream: rows in order of steps, flat and as padded arrays."""

    def __init__(self, rows: pa.Table, stream: pa.Table):
        came = stream["came"][0].values.to_numpy()
        columns, names = _sparse(rows, stream["last_step"][0].as_py())
        get = columns.__getitem__
        order = np.lexsort((get("step"), get("label"), get("end_word"), get("start_word")))
        super().__init__(get("start_word")[order], get("end_word")[order], get("label")[order], names, int(get("until").max()))
        place = np.arange(len(order)) - self.base[self.line]
        gold = {tuple(g.values()) for g in stream["gold"][0].as_py() or ()} if "gold" in stream.column_names else set()
        self.gold = np.fromiter((x in gold for x in zip(self.start.tolist(), self.end.tolist(), self.label.tolist())), dtype=bool, count=len(self.start))
        shape = (len(self.base), place.max() + 1)
        self.flat = {name: get(name)[order] for name in ("step", "until", "probability", "rescore_count", "instability", "label_margin", "extension_advantage")}

        def pad(name: str, empty, kind) -> np.ndarray:
            out = np.full(shape, empty, dtype=kind)
            out[self.line, place] = get(name)[order]
            return out

        self.step, self.until = pad("step", NEVER, np.int64), pad("until", -1, np.int64)
        self.p, self.count = pad("probability", -np.inf, float), pad("rescore_count", 0, np.int64)
        self.scored = pad("was_rescored", False, bool)
        self.real, self.came, self.last = self.until >= 0, came, int(self.until.max())

    def come(self, lag: int) -> np.ndarray:
        """Per line the step at which the word that far behind its span comes."""
        word = self.end + lag
        return np.where(word < len(self.came), self.came[np.minimum(word, len(self.came) - 1)], NEVER)

    def ranks(self, score: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """(rows from the best to the worst, the place of each row there): by score, probability, and line."""
        p = self.flat["probability"]
        order = np.argsort(-p, kind="stable") if score is None else np.lexsort((-p, -score))
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        return order, rank

    def groups(self, family: str, q: list[dict]):
        """Configurations of a family, some at a time: (their places in ``q``, for each line the number of the row that is held at the first step, that step or NEVER, scores of rows if they are not the probability)."""
        column = lambda name: np.array([x[name] for x in q])
        p, rows = self.p, self.p.shape[1]

        def held(at: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            row = np.minimum(at, rows - 1)
            return row, np.where(at < rows, np.take_along_axis(steps, row, axis=1), NEVER)

        if family == "fixed-threshold":
            yield np.arange(len(q)), *held(_reached(p, column("threshold")), self.step), None
        elif family == "rescore-patience":
            for k in sorted(set(column("patience"))):
                of = np.flatnonzero(column("patience") == k)
                yield of, *held(_reached(np.where(self.count >= k, p, -np.inf), column("threshold")[of]), self.step), None
        elif family == "fixed-lag":  # the lag is over once the word that far behind the span has come
            for lag in sorted(set(column("lag_words"))):
                of = np.flatnonzero(column("lag_words") == lag)
                at = np.maximum(self.step, self.come(lag)[:, None])
                yield of, *held(_reached(np.where(at <= self.until, p, -np.inf), column("threshold")[of]), at), None
        elif family == "snapshot-patience":  # runs of rows at the threshold; their length passes the patience inside a row
            for t in sorted(set(column("threshold"))):
                of = np.flatnonzero(column("threshold") == t)
                high = self.real & (p >= t)
                begins = high & ~np.c_[np.zeros((len(p), 1), bool), high[:, :-1]]
                begin = np.maximum.accumulate(np.where(begins, self.step, -1), axis=1)
                length, patience = np.where(high, self.until - begin + 1, -1), column("patience")[of]
                row, first = held(_reached(length, patience), begin)
                yield of, row, np.where(first == NEVER, NEVER, first + patience - 1), None
        elif family == "ema":
            for a in sorted(set(column("alpha"))):
                of = np.flatnonzero(column("alpha") == a)
                ema = np.empty_like(p)
                ema[:, 0] = p[:, 0]
                for i in range(1, rows):
                    ema[:, i] = np.where(self.scored[:, i], p[:, i] * a + ema[:, i - 1] * (1 - a), ema[:, i - 1])
                yield of, *held(_reached(np.where(self.real, ema, -np.inf), column("threshold")[of]), self.step), ema[self.real]
        elif family == "oracle-stable":
            for c, t in enumerate(column("threshold")):
                low = np.where(self.real & (p < t), self.until, 0).max(axis=1)
                first = np.maximum(low + 1, self.step[:, 0])
                first = np.where(first <= self.last, first, NEVER)[:, None]
                yield np.array([c]), np.maximum((self.step <= first).sum(axis=1) - 1, 0)[:, None], first, None
        else:
            yield from self.gates(q)

    def gates(self, q: list[dict]):
        """The gate: several bounds at once. Rows that meet one bound after the other get fewer, and configurations that are met first by the same rows go together."""
        flat, found = self.flat, {}
        kept: dict[tuple, np.ndarray] = {(): np.arange(len(self.line))}
        by_lag = {lag: np.maximum(flat["step"], self.come(lag)[self.line]) for lag in {x.get("min_tail_distance_words") for x in q} - {None}}
        for c, x in enumerate(q):
            lag = x.get("min_tail_distance_words")
            bounds = [("rescore_count", -1, -x["min_rescores"]), ("lag", 1, lag)]
            bounds += [(name, sign, sign * x[bound]) if x[use] else (name, sign, None) for use, name, sign, bound in (("use_instability", "instability", 1, "epsilon"), ("use_label_margin", "label_margin", -1, "min_label_margin"), ("use_extension", "extension_advantage", 1, "max_extension_advantage"))]
            key: tuple = ()
            for name, sign, most in bounds:
                rows, key = kept[key], (*key, most)
                if key not in kept:
                    if most is not None:
                        rows = rows[by_lag[lag][rows] <= flat["until"][rows] if name == "lag" else sign * flat[name][rows] <= most]
                    kept[key] = rows
            rows = kept[key]
            rows = rows[flat["probability"][rows] >= x["tau"]]
            if len(rows):
                line = self.line[rows]
                new = np.ones(len(rows), dtype=bool)
                np.not_equal(line[1:], line[:-1], out=new[1:])
                rows = rows[new]
                found.setdefault((lag, rows.tobytes()), []).append(c)
        met = [(of, lag, np.frombuffer(rows, dtype=np.int64)) for (lag, rows), of in found.items()]
        for i in range(0, len(met), AT_ONCE):
            part = met[i : i + AT_ONCE]
            first = np.full((len(self.base), len(part)), NEVER, dtype=np.int64)
            row = np.zeros_like(first)
            for j, (_, lag, rows) in enumerate(part):
                line = self.line[rows]
                first[line, j] = (flat["step"] if lag is None else by_lag[lag])[rows]
                row[line, j] = rows - self.base[line]
            yield [of for of, *_ in part], row, first, None

    def commits(self, family: str, q: list[dict]):
        """(places in ``q``, column of each commit, its line, its step, its score) for some configurations at a time.

        A column may stand for several places, which then commit the same; a place without commits may be missing.
        """
        plain = self.ranks(None)
        for of, row, first, score in self.groups(family, q):
            order, rank = plain if score is None else self.ranks(score)
            met = np.nonzero(first < NEVER)
            keys = np.full(first.shape, self.never, dtype=self.kind)
            keys[met] = first[met] * len(rank) + rank[self.base[met[0]] + row[met]]
            column, key = self.free(keys)
            at = order[key % len(rank)]
            yield [x if isinstance(x, list) else [int(x)] for x in of], column, self.line[at], key // len(rank), (self.flat["probability"] if score is None else score)[at]


def _one_by_one(column: np.ndarray, key: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(column, key) of the spans that are kept when those of each column are taken in the order of their keys."""
    order, kept, of, taken = np.lexsort((key, column)), [], -1, set()
    for i, c, a, b in zip(order.tolist(), column[order].tolist(), start[order].tolist(), end[order].tolist()):
        if c != of:
            of, taken = c, set()
        if taken.isdisjoint(range(a, b + 1)):
            taken.update(range(a, b + 1))
            kept.append(i)
    return column[kept], key[kept]


def _resolve(left: pa.Table, right: pa.Table, *, families: dict[str, tuple[list[str], list[dict]]], kind: str, labels: list[str] | None = None) -> pa.Table:
    names, types = [c.split()[0] for c in COUNTS.split(", ")], [pa.int64() if kind == "long" else pa.string(), pa.string(), *[pa.int64()] * 4]
    out = [pa.table([pa.array([], t) for t in types], names=names)]
    if left.num_rows:
        example, words = left["example_id"][0].as_py(), right["came"][0].values.to_numpy()
        s = _Stream(left if labels is None else _observed(left, labels), right)
        seen = np.searchsorted(words, np.arange(s.last + 2), side="right")  # words visible after each step
        for family, (ids, q) in families.items():
            for of, column, line, step, _ in s.commits(family, q):
                sums = [np.bincount(column, x, minlength=len(of)).astype(np.int64) for x in (None, s.gold[line], step, seen[step] - 1 - s.end[line])]
                at = [(c, ids[i]) for c, places in enumerate(of) if sums[0][c] for i in places]
                if at:
                    which = [c for c, _ in at]
                    out.append(pa.table([pa.array(v, t) for v, t in zip(([example] * len(at), [i for _, i in at], *(x[which] for x in sums)), types)], names=names))
    return pa.concat_tables(out)


def _rows(left: pa.Table, right: pa.Table, *, families: dict[str, tuple[list[str], list[dict]]], kind: str) -> pa.Table:
    example = pa.int64() if kind == "long" else pa.string()
    names, types = [c.split()[0] for c in ROWS.split(", ")], [pa.string(), example, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.float64()]
    out = [pa.table([pa.array([], t) for t in types], names=names)]
    if left.num_rows:
        s = _Stream(left, right)
        for family, (ids, q) in families.items():
            for of, column, line, step, score in s.commits(family, q):
                for c, places in enumerate(of):
                    mine = column == c
                    kept = line[mine]
                    for i in places:
                        columns = [[ids[i]] * len(kept), [left["example_id"][0].as_py()] * len(kept), s.start[kept], s.end[kept], s.label[kept].tolist(), step[mine], score[mine]]
                        out.append(pa.table([pa.array(v, t) for v, t in zip(columns, types)], names=names))
    return pa.concat_tables(out)


def _by_family(specs: list[Spec], look_ahead: bool) -> dict[str, tuple[list[str], list[dict]]]:
    allow_look_ahead([s.policy_id for s in specs if s.analysis_only], look_ahead)
    families: dict[str, tuple[list[str], list[dict]]] = {}
    for s in specs:
        ids, q = families.setdefault(s.family, ([], []))
        ids.append(s.policy_id)
        q.append(dict(s.parameters))
    return families


def _came(steps: DataFrame) -> DataFrame:
    """(example_id, came, last_step): the step at which each word of a stream came, from the counts of its steps, so that texts are not cut once more."""
    counts = F.array_sort(F.collect_list(F.struct("step", (F.col("visible_word_count") - F.col("past_word_count")).cast("int").alias("new"))))
    return steps.groupBy("example_id").agg(F.flatten(F.transform(counts, lambda x: F.array_repeat(x["step"], x["new"]))).alias("came"), F.max("step").alias("last_step"))


def commit_rows(obs: DataFrame, steps: DataFrame, specs: list[Spec], *, look_ahead: bool = False) -> DataFrame:
    """(policy_id, key, step, readiness): the commits themselves of every stream and configuration, for a few configurations.

    The words of a step come from its counts, so texts are not cut once more.
    """
    families = _by_family(specs, look_ahead)
    kind = dict(obs.dtypes)["example_id"].replace("bigint", "long")
    return obs.select(*SCORED).groupBy("example_id").cogroup(_came(steps).withColumnRenamed("example_id", "stream").groupBy("stream")).applyInArrow(partial(_rows, families=families, kind=kind), ROWS.format(kind=kind))


def commit_counts(obs: DataFrame, steps: DataFrame, words: DataFrame, gold: DataFrame, specs: list[Spec], *, labels: tuple[str, ...] = (), look_ahead: bool = False) -> DataFrame:
    """(example_id, policy_id, commits, correct, steps, context_words): sums over the commits of each stream and configuration that has any.

    correct: commits that are gold entities; steps and context_words: when they are made, and how many words behind the span are visible then.
    When a word came follows from the counts of the steps, so ``words`` is not read. With ``labels``, ``obs`` are scored spans with ``probs`` in their order: a row for all labels goes to the task of the stream, where the scores before and after are next to it.
    """
    families = _by_family(specs, look_ahead)
    kind = dict(obs.dtypes)["example_id"].replace("bigint", "long")
    keys = gold.groupBy("example_id").agg(F.collect_set(F.struct(*KEY[1:])).alias("gold"))
    came = _came(steps).join(keys, "example_id", "left")
    came = came.withColumnRenamed("example_id", "stream")  # another name, as both sides come from the same steps
    columns = ["example_id", "start_word", "end_word", "step", "probs"] if labels else SCORED
    grouped = obs.select(*columns).groupBy("example_id").cogroup(came.groupBy("stream"))
    return grouped.applyInArrow(partial(_resolve, families=families, kind=kind, labels=list(labels) or None), COUNTS.format(kind=kind))


def _counted(left: pa.Table, right: pa.Table, *, of: list[tuple], kind: str) -> pa.Table:
    names, types = [c.split()[0] for c in COUNTED.split(", ")], [pa.string(), pa.int64() if kind == "long" else pa.string(), *[pa.int64()] * 2, pa.string(), pa.int64(), pa.float64(), *[pa.int64()] * 3]
    out = [pa.table([pa.array([], t) for t in types], names=names)]
    if left.num_rows:
        seen, begins, ends = (right[c][0].values.to_numpy() for c in ("seen", "begins", "ends"))
        labels, code = _coded(left["label"])
        order = np.lexsort((left["step"].to_numpy(), code, left["end_word"].to_numpy(), left["start_word"].to_numpy()))
        start, end, step, p = (left[c].to_numpy()[order] for c in ("start_word", "end_word", "step", "probability"))
        s, stop = _Lines(start, end, code[order], labels, len(seen)), pc.fill_null(left["next_step"], len(seen) + 1).to_numpy()[order]
        order = np.argsort(-p, kind="stable")  # from the best to the worst row; of equal ones the first by line
        rank = np.empty(len(p), dtype=np.int64)
        rank[order] = np.arange(len(p))
        keys, rows = np.full((len(s.start), len(of)), s.never, dtype=s.kind), []
        for c, (_, threshold, lag) in enumerate(of):
            at = step if lag is None else np.maximum(step, np.searchsorted(seen, end + 1 + lag) + 1)  # the word that far behind is visible
            met = np.flatnonzero((p >= threshold) & (at < stop))
            line = s.line[met]
            first = met[np.diff(line, prepend=-1) != 0]
            keys[s.line[first], c] = at[first] * len(p) + rank[first]
            rows.append(np.bincount(line, (stop - at)[met], minlength=len(s.start)).astype(np.int64))
        example = left["example_id"][0].as_py()
        column, key = s.free(keys)
        for c, (policy, *_) in enumerate(of):
            mine = key[column == c]
            row = order[mine % len(p)]
            line = s.line[row]
            start, end_, many = s.start[line], s.end[line], len(line)
            whole = int(rows[c].sum())
            if whole:
                columns = [[policy] * many, [example] * many, start, end_, s.label[line].tolist(), mine // len(p), p[row], rows[c][line], begins[start], ends[end_]]
                out.append(pa.table([pa.array(v, t) for v, t in zip(columns, types)], names=names))
                out.append(pa.table([pa.array([v], t) for v, t in zip([policy, example, *[None] * 5, whole, None, None], types)], names=names))
    return pa.concat_tables(out)


def counted_commits(obs: DataFrame, steps: DataFrame, words: DataFrame, specs: list[Spec]) -> DataFrame:
    """(policy_id, key, step, readiness, rows, start_char, end_char): commits of thresholds and lags, and how many ready rows each has.

    One row of each policy and stream without a span says how many ready rows there are in all. A score holds to the step before the next; it is ready
    from its step, or from that at which the word that far behind the span is visible. So ready rows are counted as ends of intervals, in the task of
    their stream, and only what is committed leaves it.
    """
    if other := {s.family for s in specs} - {"fixed-threshold", "fixed-lag"}:
        raise ValueError(f"readiness of {sorted(other)} does not follow from single scores")
    of = [(s.policy_id, float(dict(s.parameters)["threshold"]), dict(s.parameters).get("lag_words")) for s in specs]
    kind = dict(obs.dtypes)["example_id"].replace("bigint", "long")
    in_order = lambda by, *values: F.array_sort(F.collect_list(F.struct(by, *values)))
    seen = steps.groupBy("example_id").agg(F.transform(in_order("step", "visible_word_count"), lambda x: x["visible_word_count"]).alias("seen"))
    places = words.groupBy("example_id").agg(in_order("word_index", "start_char", "end_char").alias("w"))
    places = places.select("example_id", F.col("w.start_char").alias("begins"), F.col("w.end_char").alias("ends"))
    side = seen.join(places, "example_id").withColumnRenamed("example_id", "stream")
    rows = obs.where(F.col("probability") >= min(t for _, t, _ in of)).select(*KEY, "step", "next_step", "probability")
    return rows.groupBy("example_id").cogroup(side.groupBy("stream")).applyInArrow(partial(_counted, of=of, kind=kind), COUNTED.format(kind=kind))


def totals(counts: DataFrame, specs: DataFrame, condition: str, conditions: list[str]) -> DataFrame:
    """Sums by condition and configuration, with a row of zeros for each configuration of ``specs`` that commits nothing."""
    sums = counts.groupBy(condition, "policy_id").agg(*(F.sum(c).alias(c) for c in ("commits", "correct", "steps", "context_words")))
    frame = specs.select("policy_id", "family", "selection_key", F.explode(F.array(*map(F.lit, conditions))).alias(condition))
    return frame.join(sums, [condition, "policy_id"], "left").na.fill(0, ["commits", "correct", "steps", "context_words"])
