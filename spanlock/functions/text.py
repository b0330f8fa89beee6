"""Tokens and offsets as column expressions.

Two coordinate systems: chunk units (runs of non-space) and model words. Offsets count code
points and are half-open; word spans are inclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: White space as code points, the same set in every regular-expression engine used here.
SPACE = r"\t-\r\x1c-\x1f\x85\p{Z}"
UNIT = rf"[^{SPACE}]+"
#: A model word: letters, digits and underscores, joined by hyphens or underscores; or any other sign.
WORD = rf"[\p{{L}}\p{{N}}_]+(?:[-_][\p{{L}}\p{{N}}_]+)*|[^{SPACE}]"


def units(text: Column | str) -> Column:
    return F.regexp_extract_all(text, F.lit(UNIT), F.lit(0))


def words(text: Column | str) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def count_units(text: Column | str) -> Column:
    return F.regexp_count(text, F.lit(UNIT)).cast("long")


def count_words(text: Column | str) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def tokens(df: DataFrame, key: list[str], text: str, pattern: str) -> DataFrame:
    """(key, token_index, token, start_char, end_char): one row per match, with offsets.

    The gaps between matches and the matches themselves tile the text, so an offset is a running
    sum of lengths inside the row's own text.
    """
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("token"))
    rows = df.select(*key, F.posexplode(pairs).alias("token_index", "p")).select(*key, F.col("token_index").cast("long").alias("token_index"), "p.gap", "p.token").where("token is not null")
    before = Window.partitionBy(*key).orderBy("token_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.length("gap") + F.length("token")).over(before)
    return rows.withColumn("end_char", end.cast("long")).select(*key, "token_index", "token", (F.col("end_char") - F.length("token")).cast("long").alias("start_char"), "end_char")


def chunks(df: DataFrame, key: list[str], text: str, units_per_chunk: int) -> DataFrame:
    """(key, step, chunk): the text cut before every n-th unit; chunks join to the text exactly.

    White space goes with the unit before it, leading white space with the first; text that is
    only white space is one chunk, empty text none.
    """
    first = rf"^[{SPACE}]*"
    pattern = rf"(?:{first})?(?:{UNIT}[{SPACE}]*){{1,{units_per_chunk}}}|^[{SPACE}]+$"
    rows = df.select(*key, F.posexplode(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("i", "chunk"))
    return rows.select(*key, (F.col("i") + 1).cast("long").alias("step"), "chunk")
