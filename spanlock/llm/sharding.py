"""Shards by a two-pass external shuffle.

First pass: every record is scattered by a seeded hash into one of as many buckets as make
``bucket_bytes`` each, whose counts fix where each bucket begins in the final order. Second pass: the
records of a bucket come together in hash order, a seeded Fisher-Yates permutation deals them
their places, and they are written in that order. A task holds one permutation
(8 bytes a record) and one Arrow batch; the records themselves stream through.

Law ``rows``: shard s holds the places from floor(s N / shards) on, so that counts are at
most one apart. Defined cases: null text has 1 byte (the separator); an empty table gives
empty shards; repeated rows are separate records; null ids are scattered by their text; records of the same
hash are dealt places in any order among themselves; a very long text is a bucket that is larger than others.
Extra columns pass through; one that has the name of a result column is replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_ROWS, cut, partitions, running_totals, shared_folder, table

def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A permutation of range(n) that depends on seed and bucket alone (numpy shuffles by Fisher-Yates)."""
    order = np.arange(n, dtype=np.int64)
    np.random.default_rng([seed, bucket]).shuffle(order)
    return order


def shuffle_shards(docs: DataFrame, shards: int = 8, *, seed: int = 29, bucket_bytes: int = 16 << 20) -> DataFrame:
    """Adds bucket, place (in the whole order), shard and slot (in its shard, from 0)."""
    spark = docs.sparkSession
    docs = docs.drop("bucket", "place", "shard", "slot")
    scatter = F.xxhash64(F.lit(seed), "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))))
    total, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1), F.lit(0))).first()
    buckets = max(1, -(-size // bucket_bytes))
    rows = docs.withColumn("__scatter", scatter).withColumn("bucket", F.pmod("__scatter", F.lit(buckets)))

    counts = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("__n"))
    counts = cut(running_totals(counts, [F.col("bucket")], {"__first": "__n"}))  # one row per bucket
    small = buckets <= BROADCAST_ROWS
    rows = rows.join(F.broadcast(counts) if small else counts, "bucket")
    rows = rows.repartitionByRange(partitions(spark), "bucket").sortWithinPartitions("bucket", "__scatter")
    rows = rows.select(*docs.columns, "bucket", "__n", "__first")
    schema = T.StructType([*docs.schema.fields, T.StructField("bucket", T.LongType()), T.StructField("place", T.LongType())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, order, at = None, None, 0
        for batch in batches:
            bucket, n, first = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("bucket", "__n", "__first"))
            place = np.empty(len(bucket), dtype=np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if bucket[a] != now:
                    now, at = bucket[a], 0
                    order = fisher_yates(int(n[a]), seed, int(now))
                place[a:b] = first[a] + order[at : at + b - a]
                at += b - a
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(place)], names=[*batch.schema.names[:-2], "place"])

    placed = rows.mapInArrow(deal, schema)
    # Shard s begins at place floor(s * total / shards).
    shard = F.expr(f"({shards}L * (place + 1) - 1) div {max(total, 1)}L")
    return placed.withColumn("shard", shard.cast("int")).withColumn("slot", F.expr(f"place - (shard * {total}L) div {shards}L"))


def write_shards(rows: DataFrame, path: str) -> DataFrame:
    """Writes one folder per shard and gives the rows as read from there.

    Tasks hold whole buckets, neighbours in the order, so each file is a run of a shard in slot order.
    """
    rows.sortWithinPartitions("shard", "place").write.mode("overwrite").partitionBy("shard").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def op7_shuffle_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 by law ``rows``, written; sizes and checksums are taken from the written texts."""
    rows = shuffle_shards(table(spark, sf_dir, "documents").select("doc_id", "text"))
    rows = write_shards(rows, f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}")
    text = F.coalesce("text", F.lit(""))
    return rows.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
