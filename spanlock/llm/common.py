"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: A table of at most this many rows may be broadcast; it is counted first.
BROADCAST_ROWS = 100_000

#: Copies of a small table when it is too large to broadcast.
SALTS = 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that is unset and all runs on one machine (tests, a laptop) is a temporary folder used, once a session.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or _own_folders.get(spark.sparkContext.applicationId)
    if folder is None and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if folder is None:
        folder = _own_folders[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="spark-checkpoint-")
    return folder


_own_folders: dict[str, str] = {}


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_small(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner", *, weight: Column | None = None) -> DataFrame:
    """Join a per-key table to a large one whose keys may be skewed.

    ``small`` has one row per key and must be cheap to count (checkpointed). It is broadcast
    up to ``BROADCAST_ROWS`` rows, where a row of arrays counts as ``weight`` rows; beyond that
    every key is copied to ``SALTS`` salts, so that a hot key of ``big`` is spread over as many tasks.
    """
    on = list(on)
    rows = small.count() if weight is None else small.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    if rows <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), on, how)
    salted = big.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    copies = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [*on, "__salt"], how).drop("__salt")


def running_totals(df: DataFrame, order: Sequence[Column], sums: dict[str, str]) -> DataFrame:
    """Add exclusive running totals over a global order, without one task seeing all rows.

    Rows are range-partitioned, the partition of each row is fixed by a checkpoint, totals
    per partition (one row each) are accumulated, and each partition continues from its offset.
    ``sums`` maps a new column to the column it accumulates.
    """
    spark = df.sparkSession
    ranged = cut(df.repartitionByRange(partitions(spark), *order).withColumn("__part", F.spark_partition_id()))
    per_part = ranged.groupBy("__part").agg(*(F.sum(c).alias(f"__sum_{new}") for new, c in sums.items()))
    before = Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select("__part", *(F.coalesce(F.sum(f"__sum_{new}").over(before), F.lit(0)).alias(f"__off_{new}") for new in sums))
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(F.broadcast(offsets), "__part")  # one row per partition
    for new, c in sums.items():
        out = out.withColumn(new, F.col(f"__off_{new}") + F.coalesce(F.sum(c).over(inside), F.lit(0)))
    return out.drop("__part", *(f"__off_{new}" for new in sums))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def crc_of_id() -> Column:
    """crc32 of doc_id written as text, the fold key of the learned operators."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and every other character as it is."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))
