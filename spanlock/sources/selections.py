"""Selections of a corpus by preset: made, stored, loaded and turned into the inputs of traces.

A selection is a run of its own (see ``runs``): its fingerprint covers the preset, the salt and the corpus it was drawn from, so the
same selection is stored once, and one that was changed since is refused. It holds identities and digests only; texts
come from the corpus when a selection is loaded, and a row that the corpus no longer has, or has otherwise, is an error.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import selection as S
from . import manifest as N
from . import runs as R

SPLITS = ("dev", "test")


class SelectionError(ValueError):
    """A selection that cannot be made, or that is not what it claims to be."""


@dataclass(frozen=True)
class Preset:
    """Rows of each task in each split."""

    name: str
    dev: int
    test: int

    def quota(self, split: str) -> int:
        return {"dev": self.dev, "test": self.test}[split]


#: The published presets.
PRESETS = {p.name: p for p in (Preset("smoke", 5, 20), Preset("small", 100, 300), Preset("full", 250, 1000))}


def preset_of(value: str | Preset) -> Preset:
    """A preset, or the one of that name."""
    if isinstance(value, Preset):
        return value
    if value not in PRESETS:
        raise SelectionError(f"unknown preset {value!r}; there are {', '.join(PRESETS)}")
    return PRESETS[value]


def labels(names: Sequence[str], *, repeats: bool = False) -> tuple[str, ...]:
    """Labels in their order: not blank, and unique or (with ``repeats``) the first of each."""
    out = tuple(names)
    if not out or any(not isinstance(x, str) or not x.strip() for x in out):
        raise SelectionError("labels must be names that are not blank")
    if not repeats and len(set(out)) != len(out):
        raise SelectionError("labels must be unique")
    return tuple(dict.fromkeys(out))


def vocabulary(rows: DataFrame, label: str = "label") -> DataFrame:
    """(task_name, labels): the labels of each task in order; a blank one is an error."""
    blank = F.coalesce(F.trim(label) == "", F.lit(True))
    sound = F.when(blank, F.raise_error(F.concat(F.lit("blank label in "), F.col("task_name"))).cast("string")).otherwise(F.col(label))
    return rows.select("task_name", sound.alias("label")).groupBy("task_name").agg(F.sort_array(F.collect_set("label")).alias("labels"))


def draw(corpus: DataFrame, preset: str | Preset, salt: str) -> DataFrame:
    """The manifest of a selection, with preset, split and rank: parents belong to one split with all their rows, and each task gives its quota."""
    of = preset_of(preset)
    rank_by = F.sha2(F.concat_ws(":", F.lit(f"{salt}:sample"), "task_name", "uid", F.col("source_row_index").cast("string")), 256)
    parent = F.concat_ws(":", F.lit(salt), "task_name", "parent_id")
    rows = corpus.select(*N.IDENTITY)
    try:
        parts = [S.parent_disjoint_sample(rows, "task_name", parent, rank_by, "source_row_index", of.quota(split), split).withColumn("split", F.lit(split)) for split in SPLITS]
    except ValueError as e:
        raise SelectionError(str(e)) from e
    return N.manifest(reduce(DataFrame.unionByName, parts).withColumn("preset", F.lit(of.name)), ("preset", "split", "rank"))


def store(spark: SparkSession, root: str, corpus: DataFrame, preset: str | Preset, salt: str) -> str:
    """Draws and stores a selection, or finds it stored; returns its run id."""
    of = preset_of(preset)
    made = R.fingerprint({"kind": "selection", "preset": of.name}, {"salt": salt, "dev": of.dev, "test": of.test}, {"corpus": corpus.select(*N.IDENTITY)})
    R.write_run(spark, root, made, {"rows": draw(corpus, of, salt)})
    return made.run_id


def load(spark: SparkSession, root: str, corpus: DataFrame, preset: str | Preset, split: str | None = None) -> DataFrame:
    """The rows of a stored selection with example_id and text, of one split or both.

    The stored rows are verified against their manifest, their quotas, ranks, parents and identities against the rules of
    selections, and every row against the corpus.
    """
    of = preset_of(preset)
    rows = R.scan(spark, root, "rows", kind="selection", preset=of.name).drop("run_id", "kind")
    rows = rows.select(*N.IDENTITY, "metadata_sha256", "split", "rank")
    wrong = [f"{split_}: {r['rule']} {r['what']}" for split_ in SPLITS for r in N.selection_faults(rows.where(F.col("split") == split_), of.quota(split_)).limit(5).collect()]
    own = rows.withColumn("parent_id", F.concat_ws("/", "task_name", "parent_id"))  # a parent belongs to its task
    wrong += [f"{r['rule']} {r['what']}" for r in N.selection_faults(own, 0).where("rule in ('parent', 'twice')").limit(5).collect()]
    if wrong:
        raise SelectionError("; ".join(wrong))
    found = N.reconstruct(rows if split is None else rows.where(F.col("split") == split), corpus)
    broken = F.concat(F.lit("row "), F.col("example_id"), F.lit(" of the selection is "), F.col("status"), F.lit(" in the corpus"))
    return found.where(F.when(F.col("status") != "ok", F.raise_error(broken).cast("boolean")).otherwise(F.lit(True))).drop("status")


def trace_inputs(loaded: DataFrame, words: DataFrame) -> DataFrame:
    """(example_id, task_name, parent_id, split, rank, text, labels): what a trace is made from. A task without a vocabulary is an error."""
    rows = loaded.join(words, "task_name", "left")
    missing = F.raise_error(F.concat(F.lit("no labels for the task "), F.col("task_name"))).cast("array<string>")
    return rows.select("example_id", "task_name", "parent_id", "split", "rank", "text", F.when(F.col("labels").isNull(), missing).otherwise(F.col("labels")).alias("labels"))
