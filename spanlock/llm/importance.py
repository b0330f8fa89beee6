"""Importance resampling towards a target distribution of hashed word runs.

A feature is a run of 1 to ``max_words`` consecutive words, and its bucket is a hash of it modulo
``buckets``. Both corpora are counted by bucket, and a bucket's gain is the smoothed log ratio of its
shares. Scoring explodes nothing: higher-order functions make the array of a document's
buckets, and one aggregate adds up ``element_at`` of the gains, which are an array literal in the
plan. Only the counts of buckets, and after scoring ids with numbers, are shuffled; a text
never leaves the task that reads it. A Gumbel variate drawn from the id makes the highest
scores a sample without replacement in proportion to the weights.

Bounds: the driver sees one count a bucket and corpus, whatever the corpora hold.

Defined cases: a null text has no words, weight 0 and, with fewer than ``min_words`` words, is never
drawn; a null id counts as an empty text in the variate and comes first among ties; rows equal in id and score
follow each other in any order; repeated rows and very long texts count whole; without a target
every gain still has its value by the smoothing; an empty table gives an empty result. Extra columns
pass through, and one that has the name of a result column is replaced by it.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UPPER, cut, running_totals, table

BUCKETS = 10_000
RESULTS = ("n_words", "n_features", "weight", "score", "rank")

#: All that ends a word: ASCII characters other than digits and letters.
_GAPS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


def words(text: str = "text") -> Column:
    """Lower-cased (A-Z only) runs of ASCII digits and letters and of everything beyond ASCII; none for null.

    A translation to spaces and a split give the matches of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` at a seventh of its time.
    """
    plain = F.translate(F.coalesce(text, F.lit("")), UPPER + _GAPS, UPPER.lower() + " " * len(_GAPS))
    return F.filter(F.split(plain, " "), lambda w: w != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once a row: inside lambdas a plain expression would be worked out for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def features(of: Column, max_words: int = 1) -> Column:
    """All runs of 1 to ``max_words`` consecutive words, repeats included, as one array."""
    if max_words == 1:
        return of

    def runs(ws: Column, n: int) -> Column:
        starts = F.when(F.size(ws) >= n, F.sequence(F.lit(1), F.size(ws) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(ws, i, F.lit(n)), " "))

    return let(of, lambda ws: F.concat(ws, *(runs(ws, n) for n in range(2, max_words + 1))))


def bucket(feature: Column, buckets: int = BUCKETS) -> Column:
    return (F.crc32(feature.cast("binary")) % buckets).cast("int")


def bucket_counts(texts: DataFrame, *, text: str = "text", max_words: int = 1, buckets: int = BUCKETS) -> list[int]:
    """How many features fall into each bucket: counted in the tasks, one total a bucket and task is shuffled."""
    rows = texts.select(F.explode(features(words(text), max_words)).alias("feature")).select(bucket(F.col("feature"), buckets).alias("bucket"))
    out = [0] * buckets
    for r in rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect():  # at most ``buckets`` rows
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: list[int], target: list[int]) -> list[int]:
    """A thousand times the log ratio of each bucket's share in the target and in the raw corpus, add-one smoothed, rounded down."""
    n, s, t = len(raw), sum(raw), sum(target)
    return [math.floor(1000 * math.log((b + 1.0) * (s + n) / ((a + 1.0) * (t + n)))) for a, b in zip(raw, target)]


def variate(seed: str, doc_id: Column) -> Column:
    """A thousand times a Gumbel variate by id, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -1000).cast("long")


def weigh(docs: DataFrame, gain: list[int], *, text: str = "text", max_words: int = 1, seed: str = "2024") -> DataFrame:
    """Adds n_words, n_features, weight (the floored mean gain of the features) and score (weight and variate)."""
    table_ = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")  # folded to one literal

    def sums(ws: Column) -> Column:
        found = F.transform(features(ws, max_words), lambda f: bucket(f, len(gain)))
        total = lambda of: F.aggregate(of, F.lit(0).cast("long"), lambda a, b: a + F.element_at(table_, b + 1))
        return let(found, lambda of: F.struct(F.size(ws).cast("long").alias("n_words"), F.size(of).cast("long").alias("n_features"), total(of).alias("total")))

    rows = docs.select(*(c for c in docs.columns if c not in RESULTS), let(words(text), sums).alias("__s"))
    rows = rows.select(*(c for c in rows.columns if c != "__s"), "__s.*")
    mean = F.when(F.col("n_features") > 0, F.expr("(total - pmod(total, n_features)) div n_features")).otherwise(0).cast("long")
    rows = rows.withColumn("weight", mean).drop("total")
    return rows.withColumn("score", F.col("weight") + variate(seed, F.col("doc_id")))


def draw(scored: DataFrame, *, percent: int = 10, min_words: int = 20) -> DataFrame:
    """Adds rank: 1, 2, 3... by falling score over the drawn documents, null for the others.

    Of the N documents with at least ``min_words`` words, ``percent`` hundredths are drawn, rounded down. The
    order is global: rows are range-partitioned and each partition goes on from the counts before it.
    """
    rows = cut(scored.withColumn("__fit", F.col("n_words") >= min_words).withColumn("__one", F.lit(1).cast("long")))
    drawn = rows.where("__fit").count() * percent // 100
    rows = running_totals(rows, [F.col("__fit").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_first()], {"__before": "__one"})
    rank = F.when(F.col("__fit") & (F.col("__before") < drawn), F.col("__before") + 1).cast("long")
    return rows.withColumn("rank", rank).drop("__fit", "__one", "__before")


def resample(docs: DataFrame, target: DataFrame, *, text: str = "text", max_words: int = 1, buckets: int = BUCKETS, seed: str = "2024", percent: int = 10, min_words: int = 20, keep: list[str] | None = None) -> DataFrame:
    """Every document with n_words, n_features, weight, score and rank; ``keep`` names the columns to keep (all but the text if None)."""
    count = lambda of: bucket_counts(of, text=text, max_words=max_words, buckets=buckets)
    gain = gains(count(docs), count(target))
    kept = [c for c in docs.columns if c != text] if keep is None else keep
    kept = list(dict.fromkeys(["doc_id", *kept]))
    scored = weigh(docs.select(*dict.fromkeys([*kept, text])), gain, text=text, max_words=max_words, seed=seed)
    return draw(scored if text in kept else scored.drop(text), percent=percent, min_words=min_words)


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents weighed against the benchmark's texts, and a tenth of those of 20 words or more drawn."""
    out = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return out.select("doc_id", "n_features", "weight", "score", "rank")


#: crc32 of a text in SQL: a table of 256 remainders, folded over the bytes.
CRC_TABLE = "ct AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"
CRC_OF = "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, CAST(strlen({0}) AS BIGINT)), lambda i: CAST('0x' || substr(hex({0}), i * 2 + 1, 2) AS BIGINT))), lambda c, b: xor(c >> 8, ct.t[(xor(c, b) & 255) + 1])), 4294967295)"
_LOWER = f"translate({{}}, '{UPPER}', '{UPPER.lower()}')"

OP11_SQL = rf"""
WITH {CRC_TABLE},
d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
dw AS (SELECT r, unnest(ws) AS w FROM d), bw AS (SELECT unnest(ws) AS w FROM b),
vo AS (SELECT DISTINCT w FROM (SELECT w FROM dw UNION ALL SELECT w FROM bw)),
vb AS (SELECT w, {CRC_OF.format("w")} % 10000 AS k FROM vo CROSS JOIN ct),
dk AS (SELECT r, k FROM dw JOIN vb USING (w)),
s AS (SELECT k, count(*) AS n FROM dk GROUP BY k), t AS (SELECT k, count(*) AS n FROM bw JOIN vb USING (w) GROUP BY k),
g AS (SELECT k, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM s), 0) + 10000)::DOUBLE / ((s.n + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM t), 0) + 10000)::DOUBLE))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (k)),
m AS (SELECT r, CAST(floor(sum(gain)::DOUBLE / count(*)) AS BIGINT) AS weight FROM dk JOIN g USING (k) GROUP BY r),
x AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
      CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT)::DOUBLE AS h FROM d LEFT JOIN m USING (r)),
y AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_features >= 20) OVER () AS n FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= n * 10 // 100 THEN place END AS rank FROM z
"""
