"""Approximate nearest neighbours by randomly rotated one-bit codes.

A vector is scaled to length 1, put into ``bits`` dimensions by a seeded random rotation, and only the signs are kept: a
packed code, beside it two correction scalars, the vector's norm and the cosine ``a`` of its code to what it stands for.
A query is rotated in the same way and written in eight bit planes, so that population counts of ``code & plane`` give
its inner product with the code; divided by ``a`` and times the norm that is an unbiased estimate of the true inner product,
and its error is a normal variate of deviation ``norm * |q| * sqrt(1 - a**2) / a / sqrt(bits - 1)`` over the rotation. ``sigmas``
deviations, and the rounding of the planes at its worst, are the error bound. A vector is computed exactly unless
its estimate plus bound is below the k-th best exact value found so far; so what is returned is exact and only a true neighbour beyond its
bound is lost (with three deviations one in 700; no list of candidates has a length limit).

All queries meet all vectors in a grid of blocks: a block of queries and a block of vectors are one group of bounded
size, with at most k results a query; the best k of those are the answer. Every row is indexed; nothing is fitted but the seed.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows without an
id; rows of one id are one vector (the largest in array order); vectors of different length do not meet; fewer than
k candidates are all returned; ties go to the smaller id; an empty table gives an empty result; extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

#: Rows of a block of vectors and of a block of queries: what one task holds at a time.
VECTORS, QUERIES = 8192, 16384

#: Bit planes of a query, and queries that are estimated at a time.
PLANES, STEP = 8, 64

CODED = "id long, dim int, vector binary, code binary, norm double, cosine double"


@lru_cache(maxsize=4)
def rotation(dim: int, bits: int, seed: int) -> np.ndarray:
    """``dim`` orthonormal columns in ``bits`` dimensions, random but for the seed."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim, bits]).standard_normal((bits, dim)))
    return q * np.sign(np.diag(r))


def code_bits(dim: int, factor: int = 2) -> int:
    """Bits of a code: ``factor`` times the dimension, in whole words."""
    return -(-dim * factor // 64) * 64


def encode(vectors: np.ndarray, factor: int = 2, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes as rows of 64-bit words, norms, cosines of the codes) of rows of doubles."""
    bits = code_bits(vectors.shape[1], factor)
    norms = np.sqrt((vectors * vectors).sum(axis=1))
    turned = (vectors / norms[:, None]) @ rotation(vectors.shape[1], bits, seed).T
    codes = np.packbits(turned > 0, axis=1, bitorder="little").view(np.uint64)
    return codes, norms, np.abs(turned).sum(axis=1) / np.sqrt(bits)


def code_vectors(rows: DataFrame, *, key: str = "vec_id", vector: str = "embedding", factor: int = 2, seed: int = 7) -> DataFrame:
    """The index, one row for each usable vector (``CODED``)."""
    usable = F.col(key).isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(vector, lambda x: x != 0)
    one = rows.where(usable).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).groupBy("id").agg(F.max("v").alias("v"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                vectors = lists.take(pa.array(at)).flatten().to_numpy().reshape(-1, dim)
                codes, norms, cosines = encode(vectors, factor, seed)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(np.full(len(at), dim, np.int32)), pa.array([x.tobytes() for x in vectors], pa.binary()), pa.array([x.tobytes() for x in codes], pa.binary()), pa.array(norms), pa.array(cosines)], names=["id", "dim", "vector", "code", "norm", "cosine"])

    return one.mapInArrow(work, CODED)


def bit_planes(turned: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rotated queries in ``PLANES`` bits a coordinate: (planes, lowest value, step, sum of the rounded coordinates)."""
    low = turned.min(axis=1)
    step = np.maximum((turned.max(axis=1) - low) / (2**PLANES - 1), np.finfo(float).tiny)
    rounded = np.rint((turned - low[:, None]) / step[:, None]).astype(np.uint8)
    planes = np.stack([np.packbits((rounded >> p) & 1, axis=1, bitorder="little").view(np.uint64) for p in range(PLANES)])
    return planes, low, step, low * turned.shape[1] + step * rounded.sum(axis=1, dtype=np.int64)


def estimates(codes, norms, cosines, queries: np.ndarray, sigmas: float, factor: int = 2, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(estimate, error bound) of the inner products of queries (rows) with coded vectors (columns)."""
    bits = codes.shape[1] * 64
    turned = queries @ rotation(queries.shape[1], bits, seed).T
    planes, low, step, total = bit_planes(turned)
    counts = np.zeros((len(queries), len(codes)), dtype=np.int32)
    for word in range(codes.shape[1]):
        of = codes[:, word]
        for p in range(PLANES):
            counts += np.bitwise_count(planes[p, :, word, None] & of).astype(np.int32) << p
    ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
    dots = (2 * (low[:, None] * ones + step[:, None] * counts) - total[:, None]) / np.sqrt(bits)
    scale = norms / cosines
    length = np.sqrt((queries * queries).sum(axis=1))
    wide = sigmas * length[:, None] * np.sqrt(np.maximum(1 - cosines * cosines, 0) / (bits - 1))
    return dots * scale, (wide + (np.sqrt(bits) / 2 * step)[:, None]) * scale


def _unpack(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    rows = rows.combine_chunks()
    n = rows.num_rows
    wide = lambda name, kind: np.frombuffer(b"".join(rows[name].to_pylist()), dtype=kind).reshape(n, -1)
    ids = rows["id"].to_numpy()
    order = np.argsort(ids, kind="stable")
    return ids[order], wide("vector", np.float64)[order], wide("code", np.uint64)[order], rows["norm"].to_numpy()[order], rows["cosine"].to_numpy()[order]


def search_block(ids, vectors, codes, norms, cosines, query_ids, queries, k: int, sigmas: float, factor: int, seed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query id, vector ids, exact inner products) of the best k of a block, best first; ids must be ascending."""
    for first in range(0, len(queries), STEP):
        some = queries[first : first + STEP]
        guess, bound = estimates(codes, norms, cosines, some, sigmas, factor, seed)
        for row, q in enumerate(some):
            own = query_ids[first + row]
            upper = guess[row] + bound[row]
            upper[ids == own] = -np.inf
            likely = np.argpartition(-guess[row], min(k, len(ids) - 1))[: k + 1]
            likely = likely[ids[likely] != own]
            exact = np.sort((vectors[likely] * q).sum(axis=1))[::-1]
            least = exact[k - 1] if len(exact) >= k else -np.inf
            at = np.flatnonzero((upper >= least) & (ids != own))
            at = np.union1d(at, likely)
            scores = (vectors[at] * q).sum(axis=1)
            best = np.lexsort((ids[at], -scores))[:k]
            yield own, ids[at[best]], scores[best]


def nearest(rows: DataFrame, is_query: Column, k: int = 20, *, key: str = "vec_id", vector: str = "embedding", sigmas: float = 3.0, factor: int = 2, seed: int = 7, block: int = VECTORS, query_block: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k vectors of largest inner product for each row where ``is_query`` (of the id) holds.

    sigmas: the error bound in deviations; more of them find more of the true neighbours and compute more inner products exactly.
    """
    coded = cut(code_vectors(rows, key=key, vector=vector, factor=factor, seed=seed))
    n, asked = coded.agg(F.count(F.lit(1)), F.count_if(is_query)).first()
    down, across = max(1, -(-n // block)), max(1, -(-asked // query_block))
    place = lambda seed_, parts: F.pmod(F.xxhash64(F.lit(seed_), "id"), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    vectors = coded.withColumn("down", place(1, down)).withColumn("across", every(across))
    queries = coded.where(is_query).select("id", "dim", "vector").withColumn("across", place(2, across)).withColumn("down", every(down))
    out_schema = "query_id long, vec_id long, score double"

    def work(key_: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[int, np.ndarray, np.ndarray]] = []
        if left.num_rows and right.num_rows:
            right = right.combine_chunks()
            asked_ = np.frombuffer(b"".join(right["vector"].to_pylist()), dtype=np.float64).reshape(right.num_rows, -1)
            found = list(search_block(*_unpack(left), right["id"].to_numpy(), asked_, k, sigmas, factor, seed))
        owner = np.repeat([q for q, _, _ in found], [len(v) for _, v, _ in found]).astype(np.int64)
        ids = np.concatenate([v for _, v, _ in found]) if found else np.zeros(0, np.int64)
        scores = np.concatenate([s for _, _, s in found]) if found else np.zeros(0)
        return pa.table({"query_id": owner, "vec_id": ids, "score": scores})

    cell = ["down", "across", "dim"]
    met = vectors.groupBy(*cell).cogroup(queries.groupBy(*cell)).applyInArrow(work, out_schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op13_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector among all others."""
    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("id") % 20 == 0)
