"""Streams of text from the shared tables, and strict readers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import chunks


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: One row per annotated sentence of a JSON-lines corpus.
CORPUS = (
    "uid string, task_name string, source_dataset string, source_uid string, parent_id string, sentence_index bigint, "
    "text string, entities array<struct<`start`:bigint,`end`:bigint,label:string>>, language string"
)


def read_corpus(spark: SparkSession, path: str, tasks: list[str] | None = None) -> DataFrame:
    """Strict JSON lines; fails on malformed rows."""
    rows = spark.read.schema(CORPUS).option("mode", "FAILFAST").json(path)
    return rows.where(F.col("task_name").isin(tasks)) if tasks else rows


def corpus_violations(rows: DataFrame) -> DataFrame:
    """(uid, rule): rows that break a rule of the corpus.

    Names are not blank, text is not empty, numbers are not negative, and an entity selects some of the text.
    """
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    bad = F.exists("entities", lambda e: e["start"].isNull() | e["end"].isNull() | (e["start"] < 0) | (e["end"] <= e["start"]) | (e["end"] > F.length("text")))
    rules = {f"blank_{c}": blank(F.col(c)) for c in ("uid", "task_name", "source_dataset", "source_uid", "parent_id", "language")}
    rules |= {"empty_text": F.coalesce(F.col("text") == "", F.lit(True)), "sentence_index": F.coalesce(F.col("sentence_index") < 0, F.lit(True)), "entity_offsets": F.col("entities").isNull() | F.coalesce(bad, F.lit(False)), "blank_label": F.coalesce(F.exists("entities", lambda e: blank(e["label"])), F.lit(False))}
    found = F.filter(F.array(*(F.when(condition, F.lit(name)) for name, condition in rules.items())), lambda r: r.isNotNull())
    return rows.select("uid", F.explode(found).alias("rule"))


#: Rows of conversations, and texts in chunks, that a task takes: each becomes some thousand score events, which a task sorts.
TURNS_PER_TASK, TEXTS_PER_TASK = 500, 100


def spread(rows: DataFrame, source: DataFrame, per: int) -> DataFrame:
    """Rows dealt by example into a number of partitions that grows with their source, so that what one task sorts does not.

    There are at least as many partitions as are set for shuffles; adaptive execution doesn't merge them by size.
    """
    spark = source.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-source.count() // per)), "example_id")


def conversation_steps(conversations: DataFrame) -> DataFrame:
    """Each turn is one append of a stream: (example_id, step, chunk, visible_char_count, first_char).

    A chunk is the turn's text and a line break, so that no word crosses two chunks. Turns are
    small and become many candidates each, so they are spread by number; all later work on a stream stays there.
    """
    order = Window.partitionBy("example_id").orderBy("turn", "role", "chunk")
    rows = conversations.select(F.col("conv_id").alias("example_id"), "turn", "role", F.concat(F.coalesce("text", F.lit("")), F.lit("\n")).alias("chunk"))
    rows = spread(rows, conversations, TURNS_PER_TASK)
    rows = rows.withColumn("step", F.row_number().over(order).cast("long"))
    seen = F.sum(F.length("chunk")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("long")
    return rows.select("example_id", "step", "chunk", seen.alias("visible_char_count"), (seen - F.length("chunk")).alias("first_char"))


def chunk_conditions(texts: DataFrame, sizes: list[int]) -> DataFrame:
    """Steps of every text cut into chunks of each size: (example_id, step, chunk, visible_char_count, first_char).

    A condition is a stream of its own: its example_id is the size, a colon and the id in ``texts``
    (id, text), so that everything downstream treats conditions apart.
    """
    parts = [chunks(texts.withColumn("example_id", F.concat(F.lit(f"{n}:"), F.col("id").cast("string"))), ["example_id"], "text", n) for n in sizes]
    rows = reduce(DataFrame.unionAll, parts)
    rows = spread(rows, texts, TEXTS_PER_TASK)
    order = Window.partitionBy("example_id").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = F.sum(F.length("chunk")).over(order).cast("long")
    return rows.select("example_id", "step", "chunk", seen.alias("visible_char_count"), (seen - F.length("chunk")).alias("first_char"))
