from __future__ import annotations

import numpy as np
import pytest
from conftest_path import table
from pyspark.sql import functions as F

from spanlock.llm import neighbours


def brute(rows, asked, k):
    """(query_id, rank, vec_id, score) over all pairs; rows: {id: vector}."""
    ids = np.array(sorted(rows))
    m = np.array([rows[i] for i in ids], dtype=float)
    out = {}
    for q in ids[[asked(i) for i in ids]]:
        score = (m * rows[q]).sum(axis=1)
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:k]
        out[int(q)] = [(r + 1, int(ids[i]), score[i]) for r, i in enumerate(order)]
    return out


def got(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


def recall(ours, theirs):
    hits = sum(len({v for _, v, _ in ours[q]} & {v for _, v, _ in theirs[q]}) for q in theirs)
    return hits / sum(map(len, theirs.values()))


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "x", 1.0) for i, v in rows], "vec_id long, embedding array<float>, code string, norm double")


def test_op13_against_brute_force(spark, sf_dir):
    rows = {r["vec_id"]: np.array(r["embedding"], dtype=float) for r in table(spark, sf_dir, "embeddings").collect()}
    ours, theirs = got(neighbours.op13_nearest(spark, sf_dir)), brute(rows, lambda i: i % 20 == 0, 20)
    assert set(ours) == set(theirs) and recall(ours, theirs) >= 0.98
    for q, found in ours.items():
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert found == sorted(found, key=lambda x: (-x[2], x[1])) and q not in {v for _, v, _ in found}
        assert all(s == pytest.approx(float(rows[q] @ rows[v]), abs=1e-12) for _, v, s in found)


def test_many_blocks_give_what_one_block_gives(spark):
    """Clustered vectors of unequal norms, in blocks of few rows."""
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((8, 40))
    rows = [(i, (centres[i % 8] + 0.3 * rng.standard_normal(40)) * (1 + i % 5)) for i in range(1500)]
    df = frame(spark, rows).cache()
    vectors = {r["vec_id"]: np.array(r["embedding"], dtype=float) for r in df.collect()}
    theirs = brute(vectors, lambda i: i % 10 == 0, 5)
    ours = got(neighbours.nearest(df, F.col("id") % 10 == 0, 5, block=200, query_block=40))
    assert set(ours) == set(theirs) and recall(ours, theirs) >= 0.98
    wide = got(neighbours.nearest(df, F.col("id") % 10 == 0, 5, sigmas=50.0, block=300))
    assert {q: [v for _, v, _ in f] for q, f in wide.items()} == {q: [v for _, v, _ in f] for q, f in theirs.items()}


def test_odd_vectors_ties_and_few_candidates(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1, 0]), (1, [1, 1]), (2, [1, 1]), (3, None), (4, []), (5, [0, 0]), (6, [1, None]), (7, [nan, 1]), (8, [inf, 1]), (None, [1, 1]), (10, [2, 0]), (10, [3, 0]), (10, [2, 9]), (20, [1, 2, 3]), (21, [1, 0, 0])]
    ours = got(neighbours.nearest(frame(spark, rows), F.col("id") % 10 == 0, 3))
    assert ours == {0: [(1, 10, 3.0), (2, 1, 1.0), (3, 2, 1.0)], 10: [(1, 0, 3.0), (2, 1, 3.0), (3, 2, 3.0)], 20: [(1, 21, 1.0)]}
    copies = got(neighbours.nearest(frame(spark, [(i, [0.3, -0.1, 0.7]) for i in range(300)]), F.col("id") == 150, 20))
    assert [v for _, v, _ in copies[150]] == list(range(20)) and len({s for _, _, s in copies[150]}) == 1
    assert neighbours.nearest(frame(spark, []), F.col("id") % 20 == 0).count() == 0


def test_estimates_are_unbiased_and_within_their_bound():
    rng = np.random.default_rng(5)
    vectors, queries = rng.standard_normal((4000, 64)) * 3, rng.standard_normal((30, 64))
    codes, norms, cosines = neighbours.encode(vectors)
    guess, bound = neighbours.estimates(codes, norms, cosines, queries, 3.0)
    error = guess - queries @ vectors.T
    assert abs(error.mean()) < 0.02 * error.std()
    assert (np.abs(error) <= bound).mean() > 0.996 and 0.6 < (np.abs(error) <= bound / 3).mean() < 0.8
