"""Pairs of texts that are just less alike than asked for are compared, but not listed."""

from __future__ import annotations

import numpy as np

from spanlock.llm import simhash as S


def bits(x: np.ndarray) -> int:
    return int(np.unpackbits(x.view(np.uint8)).sum())


def test_parities_differ_in_no_more_bits_than_sets_in_shingles():
    rng = np.random.default_rng(1)
    for n in (0, 1, 30, 3000):
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        y = np.unique(np.r_[x[n // 5 :], rng.integers(0, 1 << 63, n // 5).astype(np.uint64)])
        assert bits(S.parity(x) ^ S.parity(y)) <= len(np.setxor1d(x, y))
        assert bits(S.parity(x) ^ S.parity(x)) == 0


def test_a_family_of_edited_texts_is_not_listed_pair_by_pair_and_loses_no_link(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(40):  # four words apart from the base: mutually under 0.8; one in four has a neighbour one word away
        words = list(base)
        for at in rng.choice(24, 4, replace=False) * 5:
            words[at] = f"e{i}x{at}"
        rows.append((2 * i, " ".join(words)))
        if i % 4 == 0:
            rows.append((2 * i + 1, " ".join(words[:60] + [f"n{i}"] + words[61:])))
    sets = [S.shingle_set(t.encode(), 5) for _, t in rows]
    root = list(range(len(rows)))
    for b in range(len(rows)):
        for a in range(b):
            both = len(np.intersect1d(sets[a], sets[b]))
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                root = [root[a] if r == root[b] else r for r in root]
    listed, plain = [], S.remaining_pairs

    def counted(*args):
        out = plain(*args)
        listed.append(out.distinct().count())
        return out

    monkeypatch.setattr(S, "remaining_pairs", counted)
    kept = S.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == {rows[r][0] for r in set(root)} | set()
    assert len(rows) > len(set(root)) and listed[0] < len(rows) * 4
