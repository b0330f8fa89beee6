"""Between character offsets and words, and gold given by character offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .metrics import side_by_side


def chars_to_words(spans: DataFrame, words: DataFrame) -> DataFrame:
    """Adds start_word and end_word to spans with start_char and end_char; null where an offset is no word boundary."""
    a = words.select("example_id", F.col("word_index").alias("start_word"), "start_char")
    b = words.select("example_id", F.col("word_index").alias("end_word"), "end_char")
    return spans.join(a, ["example_id", "start_char"], "left").join(b, ["example_id", "end_char"], "left").select(*spans.columns, "start_word", "end_word")


def gold_end_words(gold: DataFrame, words: DataFrame) -> DataFrame:
    """Adds end_word: the word that ends where the gold entity ends, else the one that contains its last character, else null.

    Words and ends are put in one order per stream; an end looks ahead to the first word that does not end before it.
    """
    marks = words.select("example_id", F.col("end_char").alias("position"), F.struct(F.col("word_index").alias("word"), "start_char").alias("seen"), F.lit(0).alias("kind"))
    rows = side_by_side(marks, gold.withColumn("position", F.col("end_char")).withColumn("kind", F.lit(1)), "position")
    ahead = Window.partitionBy("example_id").orderBy(F.desc("position"), "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("seen", F.last("seen", ignorenulls=True).over(ahead)).where("kind = 1")
    return rows.select(*gold.columns, F.when(F.col("seen.start_char") < F.col("end_char"), F.col("seen.word")).alias("end_word"))


def span_texts(spans: DataFrame, texts: DataFrame) -> DataFrame:
    """Adds the text of each span, as it stands in the stream; (example_id, text) in ``texts``."""
    return spans.join(texts.select("example_id", F.col("text").alias("__text")), "example_id").select(*spans.columns, F.expr("substring(__text, cast(start_char + 1 as int), cast(end_char - start_char as int))").alias("text"))


def stream_texts(steps: DataFrame) -> DataFrame:
    """(example_id, text): the whole text of every stream."""
    chunks = F.array_sort(F.collect_list(F.struct("step", "chunk")))
    return steps.groupBy("example_id").agg(F.array_join(F.transform(chunks, lambda c: c["chunk"]), "").alias("text"))
