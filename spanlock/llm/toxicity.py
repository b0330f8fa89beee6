"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence has the score sigmoid(bias + weights of the
hashed character n-grams in it), a document the noisy-or of its sentences' scores: it is
toxic if any of them is. Weights are trained from document labels alone, and afterwards the
sentences with a score of 0.5 or more are the offending ones.

The model is fitted on a bounded sample of labelled rows (``fit_docs``, chosen by hash, each
class at most half of it). Spark tasks count in how many toxic and clean documents of the
sample each n-gram bucket occurs; buckets that are significantly more frequent in toxic ones
get a weight, and the few entries that hold such buckets are fitted in numpy.

Defined cases: null and blank texts are documents without sentences and get the score of one
empty sentence; without labels of both classes every score is the share of toxic labels;
repeated rows are scored alike; an empty table gives an empty result; extra columns pass
through, and one that has the name of a result column is replaced by it. Very long texts are scored whole,
in pieces cut at white space; a document labelled twice counts as toxic if one label says so; a score of
exactly 0.5 is toxic; buckets with the same statistics are kept in their own order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_of_id, cut, table
from .ngrams import END, blocks, hashed

ORDERS = (5, 7)
BITS = 20

#: Labelled documents that a model is fitted on, at most (about).
FIT_DOCS = 12_000
CHUNK = 1 << 12


@dataclass(frozen=True)
class Model:
    bias: float
    weights: np.ndarray  # one per order and bucket


def _padded(texts: pa.Array) -> list[str]:
    """Texts with a space on both sides, so that their first and last words have both bounds."""
    return [f" {t} " if t else "" for t in texts.to_pylist()]


def _sentences(lengths: list[int], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sentence of each position, numbered over the block, and where each begins. Pieces begin anew."""
    first = np.zeros(len(codes) + 1, dtype=bool)
    first[np.cumsum([0, *lengths])] = True
    first[1:] |= codes == END
    first = first[:-1]
    return np.cumsum(first, dtype=np.int32) - 1, np.flatnonzero(first)


def _buckets(sentence: np.ndarray, codes: np.ndarray) -> Iterator[np.ndarray]:
    """For each order the bucket at each position, or the last (unused) one if the n-gram leaves its sentence."""
    folded = np.where(codes == END, 32, codes).astype(np.uint32)
    for k, n in enumerate(ORDERS):
        bucket = hashed(folded, n, BITS) + (k << BITS)
        out = np.roll(sentence, -(n - 1)) != sentence
        out[len(out) - (n - 1) :] = True
        bucket[out] = len(ORDERS) << BITS
        yield bucket


def labelled_sample(docs: DataFrame, labels: DataFrame, *, fit_docs: int = FIT_DOCS) -> tuple[DataFrame, float]:
    """(text, toxic) of about ``fit_docs`` labelled documents at most, each class at most half; and the share of toxic labels.

    The sample is drawn from the labels by id hash and is small enough to be broadcast to the
    documents, whose texts stay where they are. Null labels, ids and texts are left out; a
    document labelled both ways is toxic; labels of documents that are not in ``docs`` do no harm.
    """
    rows = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.when(F.col("toxic") == 1, F.lit(min(1.0, fit_docs / 2 / counts.get(1, 1)))).otherwise(F.lit(min(1.0, fit_docs / 2 / counts.get(0, 1))))
    chosen = rows.where(F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1 << 20)) / float(1 << 20) < share)
    sample = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")
    return cut(sample), counts.get(1, 0) / max(1, sum(counts.values()))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many documents of each class each bucket occurs, in chunks."""
    size = len(ORDERS) << BITS
    seen = np.zeros((2, size + 1), dtype=np.int32)
    docs = np.zeros(2, dtype=np.int64)
    for batch in batches:
        texts, toxic = _padded(batch.column(0)), batch.column(1).to_pylist()
        docs += np.bincount(toxic, minlength=2)
        for of, lengths, codes in blocks(texts):
            sentence, _ = _sentences(lengths, codes)
            cuts = np.cumsum([0, *lengths])
            for bucket in _buckets(sentence, codes):
                for i, d in enumerate(of):
                    seen[toxic[d], np.unique(bucket[cuts[i] : cuts[i + 1]])] += 1
    rows = [(c, seen[:, c * CHUNK : (c + 1) * CHUNK].tobytes()) for c in range(size // CHUNK) if seen[:, c * CHUNK : (c + 1) * CHUNK].any()]
    rows.append((-1, docs.tobytes()))
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["chunk", "counts"])


def _select(least: int, chi2: float, docs: np.ndarray):
    def work(key, pdf):
        import pandas as pd

        total = sum(np.frombuffer(x, dtype=np.int32).reshape(2, -1).astype(np.int64) for x in pdf["counts"])
        clean, toxic = total
        n0, n1 = docs
        a, b, c, d = toxic, clean, n1 - toxic, n0 - clean
        with np.errstate(divide="ignore", invalid="ignore"):
            stat = (a * d - b * c).astype(float) ** 2 * (n0 + n1) / ((a + b).astype(float) * (c + d) * (a + c) * (b + d))
        keep = np.flatnonzero((toxic >= least) & (a * n0 > 3 * b * n1) & (np.nan_to_num(stat, posinf=0) >= chi2))
        odds = np.log((toxic[keep] + 0.5) / (n1 + 1)) - np.log((clean[keep] + 0.5) / (n0 + 1))
        return pd.DataFrame({"bucket": keep + key[0] * CHUNK, "odds": odds})

    return work


def _entries(buckets: np.ndarray):
    """Per document its label, its number of sentences, and the (sentence, feature) entries it has."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.full((len(ORDERS) << BITS) + 1, -1, dtype=np.int32)
        number[buckets] = np.arange(len(buckets))
        for batch in batches:
            texts, toxic = _padded(batch.column(0)), batch.column(1).to_pylist()
            count, held = np.zeros(len(texts), dtype=np.int64), [[] for _ in texts]
            for of, lengths, codes in blocks(texts):
                sentence, starts = _sentences(lengths, codes)
                doc = np.repeat(of, lengths)[starts] if len(starts) else np.zeros(0, dtype=int)
                base = count.copy()
                first = {}
                for s, d in enumerate(doc.tolist()):
                    first.setdefault(d, s)
                np.add.at(count, doc, 1)
                for bucket in _buckets(sentence, codes):
                    f = number[bucket]
                    at = np.flatnonzero(f >= 0)
                    for s, x in set(zip(sentence[at].tolist(), f[at].tolist())):
                        d = int(doc[s])
                        held[d].append((s - first[d] + int(base[d])) * len(buckets) + x)
            yield pa.RecordBatch.from_arrays([pa.array(toxic, pa.int32()), pa.array(count), pa.array(held, pa.list_(pa.int64()))], names=["toxic", "sentences", "entries"])

    return work


def _train(rows: list, odds: np.ndarray, rounds: int, ridge: float, rare: float) -> tuple[float, np.ndarray]:
    """Bias and weights by Adam on the log loss of the noisy-or. Classes weigh as the square roots of their sizes, ``rare`` being the toxic one's share."""
    f = len(odds)
    doc, sentence, feature = [], [], []
    plain = np.zeros(len(rows))
    y = np.array([r["toxic"] for r in rows], dtype=float)
    s = 0
    for i, r in enumerate(rows):
        by: dict[int, list[int]] = {}
        for e in r["entries"]:
            by.setdefault(e // f, []).append(e % f)
        plain[i] = max(1, r["sentences"]) - len(by)
        for xs in by.values():
            doc.append(i)
            sentence += [s] * len(xs)
            feature += xs
            s += 1
    doc, sentence, feature = (np.array(x, dtype=np.int64) for x in (doc, sentence, feature))
    part = rare**0.5 / (rare**0.5 + (1 - rare) ** 0.5)
    weight = np.where(y > 0, part / max(1, y.sum()), (1 - part) / max(1, (1 - y).sum()))
    w, bias = odds * 0.5, -7.0
    m = np.zeros(f + 1)
    v = np.zeros(f + 1)
    for t in range(1, rounds + 1):
        z = bias + np.bincount(sentence, w[feature], minlength=len(doc))[: len(doc)]
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        p0 = 1 / (1 + np.exp(-bias))
        none = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=len(y)) + plain * np.log1p(-p0)  # log of the chance of no toxic sentence
        q = np.clip(-np.expm1(none), 1e-9, 1)
        # d loss / d log(1 - p_s) is 1 - y + y * (1 - q) / q with the sign turned; d log(1 - p_s) / dz = -p_s
        g = weight * ((1 - y) - y * (1 - q) / q)
        gz = g[doc] * p
        grad = np.append(np.bincount(feature, gz[sentence], minlength=f)[:f] + ridge * w, gz.sum() + (g * plain).sum() * p0)
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad**2
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-12)
        w, bias = w - step[:f], bias - step[f]
    return float(bias), w


def fit(docs: DataFrame, labels: DataFrame, *, fit_docs: int = FIT_DOCS, least: int = 4, chi2: float = 12.0, rounds: int = 400, ridge: float = 1e-5) -> Model:
    """Trains on the texts of ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic)."""
    size = (len(ORDERS) << BITS) + 1
    sample, rare = labelled_sample(docs, labels, fit_docs=fit_docs)
    counted = sample.mapInArrow(_frequencies, "chunk int, counts binary").persist()
    docs = sum((np.frombuffer(r["counts"], dtype=np.int64) for r in counted.where("chunk = -1").collect()), np.zeros(2, dtype=np.int64))
    if not docs.all():
        counted.unpersist()
        share = docs[1] / max(1, docs.sum())
        return Model(float(np.log((share + 1e-6) / (1 - share + 1e-6))), np.zeros(size, dtype=np.float32))
    chosen = counted.where("chunk >= 0").groupBy("chunk").applyInPandas(_select(least, chi2, docs), "bucket long, odds double").orderBy("bucket").toPandas()
    counted.unpersist()
    buckets = chosen["bucket"].to_numpy()
    rows = sample.mapInArrow(_entries(buckets), "toxic int, sentences long, entries array<long>").collect() if len(buckets) else []
    weights = np.zeros(size, dtype=np.float32)
    bias = -7.0
    if len(buckets):
        bias, weights[buckets] = _train(rows, chosen["odds"].to_numpy(), rounds, ridge, rare)
    return Model(bias, weights)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Adds score (of the document) and offending: array of (start, stop, score), in code points of the text."""
    docs = docs.drop("score", "offending")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.withColumn("__text", F.coalesce("text", F.lit("")))
    span = T.StructType().add("start", "long").add("stop", "long").add("score", "double")
    schema = T.StructType([*docs.schema.fields]).add("score", "double").add("offending", T.ArrayType(span))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bias, weights = shared.value.bias, shared.value.weights
        low = float(np.log1p(-1 / (1 + np.exp(-bias))))
        for batch in batches:
            texts = _padded(batch.column(batch.num_columns - 1))
            none = np.zeros(len(texts))
            any_ = np.zeros(len(texts), dtype=bool)
            spans: list[list[dict]] = [[] for _ in texts]
            at = np.zeros(len(texts), dtype=np.int64)  # code points of earlier pieces
            for of, lengths, codes in blocks(texts):
                if len(codes):
                    sentence, starts = _sentences(lengths, codes)
                    z = np.full(len(starts), bias)
                    for bucket in _buckets(sentence, codes):
                        z += np.add.reduceat(weights[bucket], starts, dtype=np.float64)
                    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                    piece = np.repeat(np.arange(len(of)), lengths)[starts]
                    doc = np.array(of)[piece]
                    np.add.at(none, doc, np.log1p(-np.minimum(p, 1 - 1e-12)))
                    any_[doc] = True
                    begins = np.cumsum([0, *lengths])
                    stops = np.append(starts[1:], len(codes))
                    for s in np.flatnonzero(p >= 0.5).tolist():
                        d = int(doc[s])
                        shift = int(at[d]) - int(begins[piece[s]]) - 1
                        spans[d].append({"start": max(0, int(starts[s]) + shift), "stop": min(len(texts[d]) - 2, int(stops[s]) + shift), "score": float(p[s])})
                np.add.at(at, of, lengths)
            none[~any_] = low
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(-np.expm1(none)), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64())])))], names=schema.names)

    return rows.mapInArrow(work, schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by a model that has not seen those held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_of_id() % 5 == 0
    model = fit(docs, table(spark, sf_dir, "labels").where(~held_out))
    rows = score(docs.withColumn("held_out", held_out), model)
    return rows.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("offending").alias("n_offending"))
