"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of n-gram buckets per language are gathered by Spark tasks and summed; the matrix of
log-probabilities (languages x buckets, at most ``MATRIX_BYTES``) is broadcast, and batches
of texts are scored by sparse sums of its columns.

The model is fitted on a bounded sample: at most about ``docs_per_language`` documents of
each language, chosen by hash. Everything is scored, over the whole text.

Defined cases: null texts and texts without a letter are ``und`` with score 0; without any
usable training row every text is ``und``; ties go to the first language by code point;
repeated rows are scored alike; very long texts are scored whole, in pieces; an empty table gives an empty
result; extra columns do not matter. More languages than the matrix has room for (1,024 at 16 bits) are an error, not a cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_of_id, table
from .ngrams import SPACE, blocks, hashed

ORDERS = (1, 2, 3)
BITS = 16
MATRIX_BYTES = 256 << 20


def _buckets(lengths: list[int], codes: np.ndarray, bits: int, orders) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, usable) for each order: n-grams that stay in their piece and hold a letter."""
    ends = np.cumsum(lengths)
    last = np.repeat(ends, lengths)
    letter = codes > SPACE
    place = np.arange(len(codes))
    for n in orders:
        some = letter.copy()
        for k in range(1, n):
            some |= np.roll(letter, -k)
        yield hashed(codes, n, bits), some & (place + n <= last)


def fit(labelled: DataFrame, *, text: str = "text", label: str = "lang", docs_per_language: int = 3000, bits: int = BITS, orders=ORDERS, smoothing: float = 0.5):
    """(languages, matrix): sorted labels and float32 log-probabilities, one row per bucket."""
    rows = labelled.where(F.col(label).isNotNull() & F.col(text).isNotNull())
    counts = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(counts)
    if len(languages) * 4 << bits > MATRIX_BYTES:
        raise ValueError(f"{len(languages)} languages need a matrix of more than {MATRIX_BYTES} bytes; use fewer bits")
    if not languages:
        return languages, np.zeros((1 << bits, 0), dtype=np.float32)
    share = F.element_at(F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, docs_per_language / counts[k]))]), F.col(label))
    place = F.pmod(F.xxhash64(F.lit("fit"), text), F.lit(1 << 20)) / float(1 << 20)
    sample = rows.where(place < share).select(F.col(label).alias("label"), F.col(text).alias("text"))
    number = {k: i for i, k in enumerate(languages)}
    size = 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), size), dtype=np.int64)
        for batch in batches:
            labels, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for docs, lengths, codes in blocks(texts):
                of = np.repeat(np.array([number[labels[d]] for d in docs]), lengths)
                for bucket, usable in _buckets(lengths, codes, bits, orders):
                    total += np.bincount((of * size + bucket)[usable], minlength=total.size).reshape(total.shape)
        which, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array(bucket, pa.int32()), pa.array(total[which, bucket])], names=["l", "bucket", "n"])

    sums = sample.mapInArrow(count, "l int, bucket int, n long").groupBy("l", "bucket").agg(F.sum("n").alias("n")).toArrow()
    matrix = np.zeros((size, len(languages)))
    matrix[sums["bucket"].to_numpy(), sums["l"].to_numpy()] = sums["n"].to_numpy()
    matrix += smoothing
    return languages, np.log(matrix / matrix.sum(axis=0)).astype(np.float32)


def predict(docs: DataFrame, model, *, keep: list[Column | str], text: str = "text", orders=ORDERS) -> DataFrame:
    """The ``keep`` columns, lang_pred and score (the posterior of the language, with equal priors)."""
    languages, matrix = model
    bits = matrix.shape[0].bit_length() - 1
    shared = docs.sparkSession.sparkContext.broadcast(matrix)
    rows = docs.select(*keep, F.coalesce(text, F.lit("")).alias("__text"))
    schema = rows.drop("__text").schema.add("lang_pred", "string").add("score", "double")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = shared.value
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            sums = np.zeros((len(texts), max(1, len(languages))))
            letters = np.zeros(len(texts), dtype=bool)
            for docs_, lengths, codes in blocks(texts, (1 << 20) // max(1, len(languages) // 4)):
                lengths = np.array(lengths)
                full = np.flatnonzero(lengths)
                starts = (np.cumsum(lengths) - lengths)[full]
                of = np.array(docs_)[full]
                if not len(full):
                    continue
                np.logical_or.at(letters, of, np.logical_or.reduceat(codes > SPACE, starts))
                for bucket, usable in _buckets(lengths.tolist(), codes, bits, orders) if languages else ():
                    for k in range(len(languages)):
                        part = table_[:, k][bucket]
                        part[~usable] = 0
                        np.add.at(sums[:, k], of, np.add.reduceat(part, starts, dtype=np.float64))
            best = sums.argmax(axis=1)
            score = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
            known = letters & bool(languages)
            names = [languages[b] if k else "und" for b, k in zip(best, known)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names, pa.string()), pa.array(np.where(known, score, 0.0))], names=schema.names)

    return rows.mapInArrow(work, schema)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learned from those not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text").withColumn("held_out", crc_of_id() % 4 == 2)
    model = fit(docs.where(~F.col("held_out")))
    return predict(docs, model, keep=["doc_id", "held_out"])
