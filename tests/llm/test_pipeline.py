"""The pipeline as a whole: what each stage drops, and that clean documents stay."""

from __future__ import annotations

import random

import corpus_pipeline
from conftest_path import documents, groups, table

from spanlock.llm import decontamination, simhash


def test_stages_drop_what_they_name(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    after = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        before, after = after, stage(spark, after, sf_dir).cache()
        assert after.columns == docs.columns
        assert after.subtract(before).isEmpty()
        assert after.count() > 0.6 * before.count()
        if name == "simhash_near_dedup":
            assert simhash.keep_one(after).count() == after.count()
            assert after.select("text").distinct().count() == after.count()
    assert decontamination.contaminated(after, table(spark, sf_dir, "benchmark")).isEmpty()


def test_run_ends_in_shards(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    counts = [r["count"] for r in out.groupBy("shard").count().collect()]
    assert len(counts) == 8 and max(counts) - min(counts) <= 1
    sources = {r["source"] for r in out.select("source").distinct().collect()}
    assert len(sources) > 1


def folder(spark, tmp_path, name, docs, items=((1, "the quick brown fox jumps over the lazy dog by the river"),), labels=((4, 0), (6, 1))):
    path = tmp_path / name
    docs.write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(path / "labels.parquet"))
    return str(path)


def test_odd_and_empty_tables_go_through(spark, odd, none, tmp_path):
    assert corpus_pipeline.run(spark, folder(spark, tmp_path, "none", none)).count() == 0
    assert corpus_pipeline.run(spark, folder(spark, tmp_path, "bare", none, items=[], labels=[])).count() == 0
    out = corpus_pipeline.run(spark, folder(spark, tmp_path, "odd", odd, labels=[])).collect()
    assert {r["doc_id"] for r in out} <= {1, 4, None, 5, 6, 8} and {5, 6} & {r["doc_id"] for r in out}


def test_stages_are_brute_force_on_a_small_corpus(spark, tmp_path):
    """Stages 2 to 4 against plain Python; the first has learned nothing here and keeps all."""
    r = random.Random(41)
    own = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    item = "the quick brown fox jumps over the lazy dog by the river"
    rows = []
    for i in range(0, 90, 3):
        base = own(r.randrange(20, 80))
        near = [*base]
        near[r.randrange(len(near))] = "changed"
        rows += [(i, " ".join(base), "xx", "ab"[i % 2]), (i + 1, " ".join(near), "xx", "ab"[i % 2]), (i + 2, " ".join(own(30) + ([item] if i % 9 == 0 else []) + own(5)), "xx", "c")]
    rows += [(200, None, "xx", "c"), (201, rows[0][1], "xx", "b"), (201, rows[0][1], "xx", "b")]
    docs = documents(spark, rows)
    path = folder(spark, tmp_path, "small", docs, items=[(1, item)], labels=[(0, 0)])
    stages = dict(corpus_pipeline.STAGES)
    one = stages["toxicity"](spark, docs, path)
    assert one.count() == len(rows) and one.columns == list(corpus_pipeline.COLUMNS)
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").split()) else set() for _, t, _, _ in rows]
    root = groups(len(rows), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    left = {min(rows[k][0] for k in range(len(rows)) if root[k] == g) for g in set(root)}
    two = stages["simhash_near_dedup"](spark, one, path)
    assert sorted(x["doc_id"] for x in two.collect()) == sorted(left)
    three = stages["benchmark_decontamination"](spark, two, path)
    clean = {i for i, t, _, _ in rows if i in left and item not in (t or "")}
    assert sorted(x["doc_id"] for x in three.collect()) == sorted(clean)
    size = {i: len((t or "").split()) for i, t, _, _ in rows}
    source = {i: s for i, _, _, s in rows}
    words = {s: sum(size[i] for i in clean if source[i] == s) for s in "abc"}
    four = stages["source_mixing"](spark, three, path).collect()
    taken = {s: sum(size[x["doc_id"]] for x in four if x["source"] == s) for s in "abc"}
    target = {s: sum(words.values()) * w / 6 for s, w in zip("abc", (1, 2, 3))}
    assert all(target[s] <= 3 * words[s] and abs(taken[s] - target[s]) <= max(size.values()) for s in "abc")
    five = stages["sharding"](spark, spark.createDataFrame(four), path)
    assert five.count() == len(four) and {x["shard"] for x in five.collect()} == set(range(8))
