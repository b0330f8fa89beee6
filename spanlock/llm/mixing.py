"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight schedule over training time: knots ``(t, weight)`` joined by
straight lines. Integrating a schedule gives the source's share of the budget; the
cumulative integral is its demand for words by time. A source's documents are put in a
seeded order, the words before a document are inverted through the demand curve, and that
gives the time at which the document is trained on. Documents are range-sorted by it.

Defined cases: null text has size 0; a null source is a source of its own, ordered last; a
source without words has target 0 and nothing taken; repeated rows are separate documents;
an empty table gives an empty result. Extra columns pass through; one that has the name of
a result column is replaced by it. Ties: rows of a source that are equal in id and text stand next to each
other in its order, in any order among themselves; very long texts count whole, and one that is longer than
its source's target is cut (or, taken whole, left out).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, cut, join_small, running_totals, table

RESULTS = ("size", "source_size", "target", "taken", "positions")

#: Schedules of the production mix: the base weight is multiplied by these (t, factor) knots,
#: each with integral 1; the shape changes after every third source.
SHAPES = (((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.5), (1.0, 0.5)))


def _source_key() -> Column:
    """Sorts by code point with null last, and joins like any other value."""
    return F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source")))


def cyclic_schedule(sources: DataFrame) -> DataFrame:
    """Knots for sources numbered by ``rank`` from 0: weights 1, 2, 3, repeating."""
    base = (F.col("rank") % 3 + 1).cast("double")
    knots = [F.array(*(F.struct(F.lit(t).alias("t"), (base * f).alias("weight")) for t, f in shape)) for shape in SHAPES]
    shape = (F.floor(F.col("rank") / 3) % 3).cast("int")
    chosen = F.when(shape == 0, knots[0]).when(shape == 1, knots[1]).otherwise(knots[2])
    return sources.select("__key", F.explode(chosen).alias("k")).select("__key", "k.t", "k.weight")


def _demand(schedule: DataFrame) -> DataFrame:
    """Per source: the integral of its schedule, and the pieces of its cumulative demand."""
    w = Window.partitionBy("__key").orderBy("t")
    pieces = (
        schedule.select("__key", F.col("t").alias("t0"), F.col("weight").alias("w0"), F.lead("t").over(w).alias("t1"), F.lead("weight").over(w).alias("w1"))
        .where("t1 is not null")
        .withColumn("area", (F.col("w0") + F.col("w1")) / 2 * (F.col("t1") - F.col("t0")))
    )
    before = Window.partitionBy("__key").orderBy("t0").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("a0", F.coalesce(F.sum("area").over(before), F.lit(0.0)))
    return pieces.groupBy("__key").agg(F.sum("area").alias("weight"), F.array_sort(F.collect_list(F.struct("a0", "t0", "t1", "w0", "w1"))).alias("pieces"))


def _fill(sources: DataFrame, budget: int | None, max_repeats: int) -> DataFrame:
    """Targets by weight that stop at ``max_repeats`` times the source, the excess reshared.

    Sources are sorted by the level at which they are full; a source is full if the level
    that the sources before it leave is above its own.
    """
    cap = F.col("source_size") * max_repeats
    sources = sources.withColumn("cap", cap).withColumn("full_at", F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")).otherwise(F.lit(float("inf"))))
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    words = total[0] if budget is None else budget
    filled = running_totals(sources, [F.col("full_at"), F.col("rank")], {"caps": "cap", "weights": "weight"})
    filled = cut(filled.withColumn("full", F.col("full_at") < (F.lit(words) - F.col("caps")) / (F.lit(total[1]) - F.col("weights"))))
    rest = filled.agg(F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))), F.lit(0)), F.coalesce(F.sum(F.when(~F.col("full"), F.col("weight"))), F.lit(0.0))).first()
    level = (words - rest[0]) / rest[1] if rest[1] else 0.0
    return filled.withColumn("target", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.lit(level)))


def _time_of(words: Column) -> Column:
    """Training time at which a source's demand reaches ``words`` words: demand inverted."""
    demand = words / F.col("target") * F.col("__weight")
    piece = F.element_at(F.filter("__pieces", lambda p: p["a0"] <= demand), -1)

    def invert(p: Column) -> Column:
        area = F.greatest(demand - p["a0"], F.lit(0.0))
        slope = (p["w1"] - p["w0"]) / (p["t1"] - p["t0"])
        root = p["w0"] + F.sqrt(F.greatest(p["w0"] * p["w0"] + slope * area * 2, F.lit(0.0)))
        return F.least(p["t1"], p["t0"] + F.when(root > 0, area * 2 / root).otherwise(F.lit(0.0)))

    return F.element_at(F.transform(F.array(piece), invert), 1)


def words_of(text: str = "text") -> Column:
    """The size of a document; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded_order(seed: int = 17) -> Column:
    """A hash that puts the documents of a source in order."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit("")))))


def plan_mix(docs: DataFrame, schedule=cyclic_schedule, *, budget: int | None = None, max_repeats: int = 3, whole: bool = False, size: Column | None = None, order: Column | None = None, bucket_words: int = 2_000_000) -> DataFrame:
    """One row per document: how much of it the mix takes, and when.

    schedule: a function from the numbered sources (``__key``, ``rank``) to knots ``(__key, t,
    weight)``. budget: words of the mix, by default as many as there are. With ``whole``
    a document is taken whole or not at all in each pass; else the last one of the last
    pass is cut, so that the words taken equal the rounded target. size and order: the words
    of a row and its place in its source, if they are known already; by default they are taken from the text.

    Adds size, source_size, target, taken and positions (a time in the schedule for each
    copy taken, at most ``max_repeats``). A source is cut by hash into buckets of about
    ``bucket_words`` words, so that no task orders a whole source.
    """
    size = words_of() if size is None else size
    order = seeded_order() if order is None else order
    columns = [c for c in docs.columns if c not in RESULTS]
    rows = docs.select(*columns, _source_key().alias("__key"), size.alias("__size"), order.alias("__order")).withColumnRenamed("__size", "size")
    sources = running_totals(rows.groupBy("__key").agg(F.sum("size").alias("source_size"), F.lit(1).alias("one")), [F.col("__key")], {"rank": "one"}).drop("one")
    sources = cut(sources)
    sources = sources.join(_demand(schedule(sources)), "__key")
    sources = cut(_fill(sources, budget, max_repeats).select("__key", "source_size", "target", F.col("weight").alias("__weight"), F.col("pieces").alias("__pieces"), F.greatest(F.ceil(F.col("source_size") / bucket_words), F.lit(1)).alias("__buckets")))

    rows = join_small(rows, sources, ["__key"])
    bucket = F.floor(F.conv(F.substring("__order", 1, 8), 16, 10).cast("double") / 2.0**32 * F.col("__buckets"))
    rows = rows.withColumn("__bucket", bucket)
    sums = rows.groupBy("__key", "__bucket").agg(F.sum("size").alias("__words"))
    before = Window.partitionBy("__key").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("__key", "__bucket", F.coalesce(F.sum("__words").over(before), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy("__key", "__bucket").orderBy("__order", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__start", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(sums.hint("merge"), ["__key", "__bucket"])
    rows = rows.withColumn("__start", F.col("__start") + F.col("__offset"))

    wanted = F.round("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(wanted / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rows = rows.withColumn("__passes", passes).withColumn("__left", wanted - F.col("__passes") * F.col("source_size"))
    if whole:
        last = F.when(F.col("__start") * 2 + F.col("size") < F.col("__left") * 2, F.col("size")).otherwise(F.lit(0))
        more = F.col("__start") * 2 + F.col("size") < F.col("__left") * 2
    else:
        last = F.greatest(F.lit(0), F.least(F.col("size"), F.col("__left") - F.col("__start")))
        more = F.col("__start") < F.col("__left")
    rows = rows.withColumn("taken", F.col("__passes") * F.col("size") + last).withColumn("__copies", F.col("__passes") + more.cast("long"))
    middle = lambda c: c * F.col("source_size") + F.col("__start") + F.col("size") / 2
    positions = F.when(F.col("__copies") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("__copies") - 1), lambda c: _time_of(middle(c)))).otherwise(F.array().cast("array<double>"))
    return rows.select(*columns, "size", "source_size", "target", "taken", positions.alias("positions"))


def mix(docs: DataFrame, schedule=cyclic_schedule, **options) -> DataFrame:
    """The mix itself: one row per copy, range-sorted by ``position``."""
    rows = plan_mix(docs, schedule, **options)
    rows = rows.withColumn("position", F.explode("positions")).drop("positions")
    return rows.orderBy("position")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to weights 1, 2, 3, repeating, in training order.

    Also returns copies (how often the mix takes the document) and position (the time of the first copy; null if none).
    """
    docs = table(spark, sf_dir, "documents")
    thin = cut(docs.select("doc_id", "source", words_of().alias("words"), seeded_order().alias("order")))  # texts are read once and never travel
    rows = plan_mix(thin, size=F.col("words"), order=F.col("order"))
    rows = rows.select("doc_id", "size", "source_size", "target", "taken", F.size("positions").cast("long").alias("copies"), F.try_element_at("positions", F.lit(1)).alias("position"))
    return rows.orderBy("position", "doc_id")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS k,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(concat_ws(':', '17', coalesce(CAST(doc_id AS VARCHAR), ''), md5(coalesce(text, '')))) AS o
  FROM documents),
s0 AS (SELECT k, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY k),
s1 AS (SELECT *, row_number() OVER (ORDER BY k) - 1 AS rank FROM s0),
s2 AS (SELECT *, CAST(rank % 3 + 1 AS DOUBLE) AS w, source_size * 3 AS cap FROM s1),
s3 AS (SELECT *, CAST(cap AS DOUBLE) / w AS full_at,
              CAST((SELECT sum(source_size) FROM s2) AS BIGINT) AS words, (SELECT sum(w) FROM s2) AS ws FROM s2),
s4 AS (SELECT *, CAST(coalesce(sum(cap) OVER b, 0) AS BIGINT) AS caps, coalesce(sum(w) OVER b, 0.0) AS weights FROM s3
       WINDOW b AS (ORDER BY full_at, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s5 AS (SELECT *, full_at < CAST(words - caps AS DOUBLE) / (ws - weights) AS is_full FROM s4),
s6 AS (SELECT *, CAST(words - coalesce((SELECT sum(cap) FROM s5 WHERE is_full), 0) AS DOUBLE)
                 / (SELECT sum(w) FROM s5 WHERE NOT is_full) AS level FROM s5),
s7 AS (SELECT *, CASE WHEN is_full THEN CAST(cap AS DOUBLE) ELSE w * level END AS target FROM s6),
shapes (shape, from_factor, to_factor) AS (VALUES (0, 0.5::DOUBLE, 1.5::DOUBLE), (1, 1::DOUBLE, 1::DOUBLE), (2, 1.5::DOUBLE, 0.5::DOUBLE)),
s8 AS (SELECT s7.*, w * from_factor AS begins, w * to_factor - w * from_factor AS slope FROM s7 JOIN shapes ON rank // 3 % 3 = shape),
p0 AS (SELECT doc_id, size, source_size, target, w, begins, slope, CAST(round(target) AS BIGINT) AS wanted,
              CAST(coalesce(sum(size) OVER (PARTITION BY d.k ORDER BY o, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
       FROM d JOIN s8 USING (k)),
p1 AS (SELECT *, CASE WHEN source_size > 0 THEN wanted // source_size ELSE 0 END AS passes FROM p0),
p2 AS (SELECT *, wanted - passes * source_size AS rest FROM p1),
p3 AS (SELECT *, CAST(passes + CASE WHEN start < rest THEN 1 ELSE 0 END AS BIGINT) AS copies,
              greatest((start + CAST(size AS DOUBLE) / 2) / target * w, 0::DOUBLE) AS demand FROM p2),
p4 AS (SELECT *, begins + sqrt(greatest(begins * begins + slope * demand * 2, 0::DOUBLE)) AS root FROM p3)
SELECT doc_id, size, source_size, target,
       CAST(passes * size + greatest(0, least(size, rest - start)) AS BIGINT) AS taken, copies,
       CASE WHEN copies > 0 THEN least(1::DOUBLE, CASE WHEN root > 0 THEN demand * 2 / root ELSE 0 END) END AS position
FROM p4
"""
