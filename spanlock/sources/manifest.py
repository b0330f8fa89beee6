"""Manifests: which rows of a corpus an experiment takes, and whether the corpus still has them.

A manifest holds identities and digests, never content. Row identity is (uid, source_row_index), as a uid
alone may repeat.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

IDENTITY = ("uid", "source_row_index", "task_name", "parent_id", "language")
#: Columns that a manifest or a report must not have.
CONTENT = frozenset("text entities chunk chunks accumulated_text span_text logits probs".split())


def record_digest(*columns: str) -> Column:
    """SHA-256 of a row's identity; null is the empty string."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), 256)


def manifest(rows: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """(IDENTITY, extra, metadata_sha256): the manifest of corpus rows."""
    return without_content(rows.select(*IDENTITY, *extra).withColumn("metadata_sha256", record_digest(*IDENTITY)))


def without_content(rows: DataFrame) -> DataFrame:
    """The same rows; a column that holds content, at any depth, is an error."""
    def names(kind) -> list[str]:
        inner = getattr(kind, "elementType", None) or getattr(kind, "valueType", None)
        if hasattr(kind, "fields"):
            return [n for f in kind.fields for n in (f.name, *names(f.dataType))]
        return names(inner) if inner is not None else []

    found = sorted(CONTENT & set(names(rows.schema)))
    if found:
        raise ValueError(f"content in a manifest or report: {', '.join(found)}")
    return rows


def reconstruct(listed: DataFrame, corpus: DataFrame, prefix: str = "corpus") -> DataFrame:
    """Every listed row with its example_id, the corpus text, and a status: ok, missing, or differs (another digest)."""
    own = corpus.select(*IDENTITY, "text").withColumn("found", record_digest(*IDENTITY)).select("uid", "source_row_index", "text", "found")
    rows = listed.join(own, ["uid", "source_row_index"], "left")
    status = F.when(F.col("found").isNull(), "missing").when(F.col("found") != F.col("metadata_sha256"), "differs").otherwise("ok")
    example = F.concat_ws(":", F.lit(prefix), "task_name", F.col("source_row_index").cast("string"), "uid")
    return rows.select(*listed.columns, example.alias("example_id"), "text", status.alias("status"))


def selection_faults(listed: DataFrame, quota: int) -> DataFrame:
    """(rule, what): what is wrong with a selection of (split, task_name, parent_id, uid, source_row_index, rank).

    quota: a task of a split has another number of rows; parent: a parent is in two splits; twice: a row is listed
    twice; rank: the ranks of a task do not count from 1.
    """
    group = F.concat_ws("/", "split", "task_name")
    per = listed.groupBy(group.alias("what")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("rank").alias("ranks"), F.min("rank").alias("low"), F.max("rank").alias("high"))
    parents = listed.groupBy(F.col("parent_id").alias("what")).agg(F.countDistinct("split").alias("splits"))
    twice = listed.groupBy("uid", "source_row_index").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    name = lambda df, rule: df.select(F.lit(rule).alias("rule"), "what")
    return reduce(
        DataFrame.unionAll,
        [
            name(per.where(F.col("n") != quota), "quota"),
            name(per.where("ranks <> n or low <> 1 or high <> n"), "rank"),
            name(parents.where("splits > 1"), "parent"),
            name(twice.select(F.concat_ws("#", "uid", F.col("source_row_index").cast("string")).alias("what")), "twice"),
        ],
    )


# --- sweeps that go on where they stopped ---


def sweep(spark: SparkSession, folder: str, keys: list[str], evaluate: Callable[[list[str]], DataFrame], *, batch: int = 64, key: str = "policy_id") -> DataFrame:
    """The rows of all ``keys``, evaluated in batches; batches that a former run finished are read, not run.

    Each batch is written as a partition of ``results`` and then, when it is whole, noted in ``done`` with
    its number of rows and digest. A batch whose rows are not what its note says is an error.
    """
    done = {}
    if _exists(spark, f"{folder}/done"):
        done = {r["batch"]: (r["rows"], r["digest"]) for r in spark.read.parquet(f"{folder}/done").collect()}  # one row for each batch
    parts = []
    for i in range(0, len(keys), batch):
        of = sorted(keys[i : i + batch])
        name = spark.range(1).select(F.sha2(F.lit("|".join(of)), 256)).first()[0][:16]
        path = f"{folder}/results/batch={name}"
        if name not in done:
            evaluate(of).write.mode("overwrite").parquet(path)
            facts = _facts(spark.read.parquet(path))
            spark.createDataFrame([(name, *facts)], "batch string, rows long, digest string").coalesce(1).write.mode("append").parquet(f"{folder}/done")
        elif _facts(spark.read.parquet(path)) != done[name]:
            raise ValueError(f"the results in {path} differ from their note")
        parts.append(spark.read.parquet(path))
    return reduce(DataFrame.unionByName, parts).where(F.col(key).isin(list(keys)))


def _facts(df: DataFrame) -> tuple[int, str]:
    row = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("d")).first()
    return row["n"], row["d"]


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark can read a folder; it may lie in a store that only Spark reaches."""
    from pyspark.errors import AnalysisException

    try:
        spark.read.parquet(path).schema
    except AnalysisException:
        return False
    return True


def conditions(runs: DataFrame, *, split: str, sizes: list[int]) -> DataFrame:
    """(run_id, split, chunk_words): the one run of each chunk size, from the runs of a partitioned folder; none or several are an error."""
    own = runs.where((F.col("split") == split) & F.col("chunk_words").isin(sizes)).select("run_id", "split", "chunk_words").distinct()  # partition columns: other folders are not read
    found = {r["chunk_words"]: r["n"] for r in own.groupBy("chunk_words").agg(F.count(F.lit(1)).alias("n")).collect()}
    wrong = [n for n in sizes if found.get(n) != 1]
    if wrong:
        raise ValueError(f"not exactly one run of {split} for the chunk sizes {wrong}")
    return own
