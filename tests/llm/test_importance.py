from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

from conftest_path import documents
from oracle import assert_same
from pyspark.sql import functions as F

from spanlock.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def naive(docs, target, max_words=1, buckets=10_000, percent=10, min_words=20):
    """(doc_id, n_features, weight, score, rank) in plain Python."""

    def of(text):
        ws = WORD.findall((text or "").translate(LOWER))
        return len(ws), [" ".join(ws[i : i + n]) for n in range(1, max_words + 1) for i in range(len(ws) - n + 1)]

    at = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(at(f) for x in texts for f in of(x)[1]) for texts in ([d[1] for d in docs], target))
    S, T = sum(s.values()), sum(t.values())
    rows = []
    for doc_id, text in docs:
        n, fs = of(text)
        gain = [math.floor(1000 * math.log((t[at(f)] + 1) * (S + buckets) / ((s[at(f)] + 1) * (T + buckets)))) for f in fs]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append((n, doc_id, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in rows if r[0] >= min_words), key=lambda r: (-r[4], -1 if r[1] is None else r[1]))
    rank = {id(r): i + 1 for i, r in enumerate(fit[: len(fit) * percent // 100])}
    return sorted(((*r[1:], rank.get(id(r))) for r in rows), key=str)


def got(df):
    return sorted(map(tuple, df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def test_op11_equals_sql(spark, sf_dir):
    assert_same(spark, sf_dir, importance.op11_resample, importance.OP11_SQL)


def test_words_are_those_of_the_pattern(spark):
    texts = ["Ab-c d\x00e\x7ff  İSTANBUL éÀ 9x_y\n\t　z", "", "...", "😀A b😀", "".join(map(chr, range(256)))]
    rows = documents(spark, list(enumerate(texts))).select("doc_id", importance.words().alias("w")).collect()
    assert {r["doc_id"]: r["w"] for r in rows} == {i: WORD.findall(t.translate(LOWER)) for i, t in enumerate(texts)}


def test_runs_of_up_to_three_words_and_odd_rows(spark, odd):
    docs = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    docs = [*docs, *((100 + i, f"common words and number {i % 7} " * 6) for i in range(60)), (161, " ".join(f"w{i}" for i in range(20))), (162, " ".join(f"w{i}" for i in range(19)))]
    target = [(1, "common words"), (2, None), (3, "NUMBER 3 and w5 w6 w7")]
    out = importance.resample(documents(spark, docs), documents(spark, target), max_words=3, percent=50)
    assert got(out) == naive(docs, [t for _, t in target], max_words=3, percent=50)
    assert "p" in out.columns and out.columns.count("score") == 1 and "text" not in out.columns


def test_no_target_no_documents(spark, none):
    docs = [(i, "a b c " * 10) for i in range(10)]
    assert got(importance.resample(documents(spark, docs), none)) == naive(docs, [])
    assert importance.resample(none, documents(spark, docs)).count() == 0


def test_copies_of_one_text_are_drawn_by_their_ids(spark):
    """One text holds most rows: weights tie, scores do not, and the order over partitions has no gap."""
    docs = [(i, "the same text again " * 5) for i in range(500)] + [(1000 + i, f"other {i} " * 15) for i in range(50)]
    out = importance.resample(documents(spark, docs), documents(spark, [(1, "other")]), percent=30)
    assert got(out) == naive(docs, ["other"], percent=30)
    ranks = [r["rank"] for r in out.where("rank is not null").select("rank").collect()]
    assert sorted(ranks) == list(range(1, 166))


def test_scoring_has_no_exchange_and_no_explode(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = importance.weigh(docs, [0] * 100)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan
    assert importance.weigh(docs, [7] * 100).where(F.col("weight") != F.when(F.col("n_features") > 0, 7).otherwise(0)).count() == 0
