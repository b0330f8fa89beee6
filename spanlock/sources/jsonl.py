"""JSON lines as a source whose bytes, rows and order are known.

Files are read in byte ranges, many tasks a file. A line knows the range that it begins in and its place there; with the
number of lines of the ranges before, which is one row a range, that makes its row number in the source, so rows are numbered
without a shuffle. The digest of a source is a tree: every line has a digest, every ``BLOCK`` consecutive ones make that of their block, and
so on up to one. It follows from the lines and their order alone, not from how the files were split into ranges, and a source of any
size has it without being read by one task.

A line ends at a line feed; the last one may lack it. Carriage returns belong to their line. Files follow each other by path.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Lines of a block, and nodes of a run in the tree above.
BLOCK = 4096


class SourceError(ValueError):
    """A source that is not the one that was asked for."""


@dataclass(frozen=True)
class Facts:
    """What identifies a source: its bytes, its physical rows, and the root of its digests."""

    bytes: int
    rows: int
    digest: str


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """(row_index, line): all lines by their place in the source, counted from 0."""
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"), F.monotonically_increasing_id().alias("place"))
    ranges = lines.groupBy("file", "begin").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    found, before = [], 0
    for r in sorted(ranges.collect(), key=lambda r: (r["file"], r["begin"])):  # one row a byte range
        found.append((r["file"], r["begin"], before - r["first"]))
        before += r["n"]
    shifts = spark.createDataFrame(found, "file string, begin long, shift long")
    return lines.join(F.broadcast(shifts), ["file", "begin"]).select((F.col("place") + F.col("shift")).alias("row_index"), "line")


def blocks(lines: DataFrame, size: int = BLOCK) -> DataFrame:
    """(block, rows, bytes, digest) of numbered lines; bytes count a line feed for every line."""
    rows = lines.select(F.expr(f"row_index div {size}").alias("block"), F.struct("row_index", F.sha2("line", 256).alias("digest")).alias("d"), (F.octet_length("line") + 1).cast("long").alias("n"))
    digests = F.transform(F.array_sort(F.collect_list("d")), lambda d: d["digest"])
    return rows.groupBy("block").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("bytes"), F.sha2(F.array_join(digests, ""), 256).alias("digest"))


def root(of: DataFrame, size: int = BLOCK) -> str:
    """The one digest above all blocks; that of no lines is the digest of nothing. Each round is ``size`` times smaller."""
    here = of.select("block", "digest")
    while True:
        if here.count() <= size:
            rows = sorted(here.collect())  # at most ``size`` digests
            return rows[0]["digest"] if len(rows) == 1 else here.sparkSession.range(1).select(F.sha2(F.lit("".join(r["digest"] for r in rows)), 256)).first()[0]
        run = F.transform(F.array_sort(F.collect_list(F.struct("block", "digest"))), lambda d: d["digest"])
        here = here.groupBy(F.expr(f"block div {size}").alias("block")).agg(F.sha2(F.array_join(run, ""), 256).alias("digest"))


def length_of(spark: SparkSession, path: str) -> int:
    """Bytes of the files of a source, as their store says."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where).getLength() if not any(c in path for c in "*?[{") else sum(s.getLen() for s in where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where))


def facts(spark: SparkSession, path: str, size: int = BLOCK) -> Facts:
    of = blocks(numbered(spark, path), size)
    return Facts(length_of(spark, path), of.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0], root(of, size))


def verify(spark: SparkSession, path: str, expected: Facts, size: int = BLOCK) -> Facts:
    """The facts of a source; what differs from the expected ones is an error that names it. The length is looked at before anything is read."""
    length = length_of(spark, path)
    if length != expected.bytes:
        raise SourceError(f"{path} has {length} bytes instead of {expected.bytes}")
    found = facts(spark, path, size)
    for name in ("rows", "digest"):
        if getattr(found, name) != getattr(expected, name):
            raise SourceError(f"the {name} of {path} differ from what was expected")
    return found


def scan(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """(row_index, columns of the schema): the objects of a source by row; a line that is no such object is an error that names its row."""
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    strict = F.from_json("line", StructType([*kind.fields, *StructType.fromDDL("__bad string").fields]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"})
    rows = numbered(spark, path).withColumn("o", strict)
    bad = F.col("o").isNull() | F.col("o.__bad").isNotNull() | (F.trim("line") == "")
    rows = rows.withColumn("o", F.when(bad, F.raise_error(F.concat(F.lit("row "), F.col("row_index").cast("string"), F.lit(" is not an object of the schema"))).cast(rows.schema["o"].dataType)).otherwise(F.col("o")))
    return rows.select("row_index", *(F.col(f"o.{f.name}") for f in kind.fields))
