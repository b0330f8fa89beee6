"""Trace folders: tables of one run with a manifest that proves them whole, and their integrity rules.

A folder holds one Parquet table per name and, written last, ``manifest``: rows, schema and
a digest of each table. A folder without a manifest is an unfinished write. The digest is a sum of
row hashes, so it does not depend on order or files, and Spark computes it where the rows are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MANIFEST = "table string, n_rows long, digest string, schema string"


def _facts(name: str, df: DataFrame) -> tuple[str, int, str, str]:
    columns = sorted(df.columns)
    row = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64(*columns).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("d")).first()
    return name, row["n"], row["d"], ",".join(f"{c} {dict(df.dtypes)[c]}" for c in columns)


def write_run(tables: dict[str, DataFrame], folder: str) -> None:
    """Writes every table and then the manifest; an existing folder is an error."""
    for name, df in tables.items():
        df.write.option("compression", "zstd").parquet(f"{folder}/{name}")
    spark = next(iter(tables.values())).sparkSession
    facts = [_facts(name, spark.read.parquet(f"{folder}/{name}")) for name in tables]
    spark.createDataFrame(facts, MANIFEST).coalesce(1).write.parquet(f"{folder}/manifest")


def read_run(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of a run; a table that is not what its manifest says is an error."""
    out = {}
    for row in spark.read.parquet(f"{folder}/manifest").collect():  # one row per table
        df = spark.read.parquet(f"{folder}/{row['table']}")
        if _facts(row["table"], df) != tuple(row):
            raise ValueError(f"table {row['table']} in {folder} differs from its manifest")
        out[row["table"]] = df
    return out


def violations(steps: DataFrame, updates: DataFrame) -> DataFrame:
    """(rule, example_id, step): rows that break a rule of the event log.

    Steps count from 1 without gaps; visible text and words never shrink; a step sees its own
    chunk; updates belong to a step, have ordered words that are visible, and probabilities in
    [0, 1]; a span is scored once a step.
    """
    order = Window.partitionBy("example_id").orderBy("step")
    s = steps.withColumn("was", F.lag("visible_char_count").over(order)).withColumn("words_were", F.lag("visible_word_count").over(order)).withColumn("number", F.row_number().over(order))
    of_steps = {
        "step_gap": F.col("step") != F.col("number"),
        "text_shrinks": F.col("visible_char_count") < F.col("was"),
        "words_shrink": F.col("visible_word_count") < F.col("words_were"),
        "chunk_length": F.col("visible_char_count") - F.coalesce("was", F.lit(0)) != F.length("chunk"),
    }
    none = F.lit(0).cast("long")
    # The log is read once: how often an event is there and how often its probabilities are broken, then what its step has seen
    # (a step that is there twice counts twice). The steps grow with the streams, so they are never broadcast through the driver.
    broken = F.exists("probs", lambda p: p.isNull() | F.isnan(p) | (p < 0) | (p > 1))
    u = updates.groupBy("example_id", "step", "start_word", "end_word").agg(F.count(F.lit(1)).alias("n"), F.count_if(broken).alias("bad"))
    known = steps.groupBy("example_id", "step").agg(F.count(F.lit(1)).alias("times"), F.collect_list("visible_word_count").alias("seen"))
    u = u.join(known.hint("merge"), ["example_id", "step"], "left").withColumn("seen", F.coalesce("seen", F.array()))
    times = F.coalesce("times", F.lit(1).cast("long"))
    of_updates = {
        "unknown_step": F.col("n") * (times - F.size("seen")),
        "word_order": F.when((F.col("start_word") < 0) | (F.col("end_word") < F.col("start_word")), F.col("n") * times),
        "unseen_word": F.col("n") * F.size(F.filter("seen", lambda w: F.col("end_word") >= w)),
        "probability": F.col("bad") * times,
        "scored_twice": F.when(F.col("n") > 1, F.lit(1)),
    }

    def rows(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
        found = (F.array_repeat(F.lit(name), F.coalesce(n, none).cast("int")) for name, n in rules.items())
        return df.select(F.explode(F.concat(*found)).alias("rule"), "example_id", "step")

    return rows(s, {name: F.when(met, F.lit(1)) for name, met in of_steps.items()}).unionAll(rows(u, of_updates))
