"""A corpus from raw documents to shards: five stages, each over everything the one before kept.

Every stage takes and returns documents; ``run`` writes each result as Parquet in the folder
all executors share and reads it again. Stages other than the last return the columns of
``documents``; extra columns of the input end here.

Defined cases: empty tables give no rows; null texts are empty documents, of which one stays; rows
with a null id are kept apart by their texts; of rows equal in id and text one stays; without labels of both classes
no document is toxic; without items none is contaminated; a document that the mix takes twice is two rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanlock.llm import decontamination, mixing, sharding, simhash, toxicity
from spanlock.llm.common import crc_of_id, shared_folder, table

#: Rows of a batch that goes to Python and back; whole texts lie in it on both sides of a task.
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.5. The model learns from the labels outside the held-out fold."""
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where(crc_of_id() % 5 != 0))
    return toxicity.score(docs.select(*COLUMNS), model).where("score < 0.5").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id."""
    return simhash.keep_one(docs.select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    hits = decontamination.contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.select(*COLUMNS).join(hits, docs.doc_id.eqNullSafe(hits.doc_id), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents mixed to weights 1, 2, 3, repeating, in training order; a document taken twice is two rows."""
    return mixing.mix(docs.select(*COLUMNS), whole=True).select(*COLUMNS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Eight shards of shuffled documents, written and read back."""
    return sharding.write_shards(sharding.shuffle_shards(docs.select(*COLUMNS), 8), f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mixing", mix_sources),
    ("sharding", shard),
]

#: Trained models, fingerprints and edit distances are not SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    before = spark.conf.get(BATCH, None)
    spark.conf.set(BATCH, str(BATCH_ROWS))  # stages are run here, so the session has its own value back when this ends
    try:
        for name, stage in STAGES:
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
    finally:
        spark.conf.unset(BATCH) if before is None else spark.conf.set(BATCH, before)
    return docs
