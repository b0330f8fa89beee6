from __future__ import annotations

import struct
import zlib

import numpy as np
import xxhash
from conftest_path import documents, table
from oracle import assert_same
from pyspark.sql import functions as F

from spanlock.llm import licenses, mixing, sharding


def test_mix_equals_sql(spark, sf_dir):
    assert_same(spark, sf_dir, mixing.op1_mix_sources, mixing.OP1_SQL)


def test_mix_targets_cap_and_reshare(spark):
    rows = [(i, "w " * 10, None, "a") for i in range(10)] + [(100 + i, "w " * 100, None, "b") for i in range(10)]
    out = mixing.plan_mix(documents(spark, rows), bucket_words=50).groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("n")).collect()
    got = {r["source"]: (r["t"], r["n"]) for r in out}
    # 1100 words at 1 : 2 would give a 366; it stops at 300 and b takes the rest.
    assert got == {"a": (300.0, 300), "b": (800.0, 800)}


def test_mix_positions_follow_the_schedule(spark):
    rows = [(i, "w " * 5, None, s) for s in "abc" for i in range(300)]
    early = {r["source"]: r["n"] for r in mixing.mix(documents(spark, rows)).where("position < 0.5").groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert early["a"] < 150 * 3 and set(early) == {"a", "b", "c"}


def test_mix_query_is_in_training_order(spark, sf_dir):
    rows = mixing.op1_mix_sources(spark, sf_dir).collect()
    times = [r["position"] for r in rows if r["position"] is not None]
    assert times == sorted(times) and 0 <= times[0] and times[-1] <= 1
    assert all((r["position"] is None) == (r["copies"] == 0) and r["taken"] <= r["copies"] * r["size"] for r in rows)


def test_mix_odd_and_empty(spark, odd, none):
    out = mixing.plan_mix(odd)
    rows = out.collect()
    assert len(rows) == 10 and all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    assert "p" in out.columns and all(out.columns.count(name) == 1 for name in mixing.RESULTS)
    assert mixing.mix(none).count() == 0


def test_shards_are_a_permutation(spark, sf_dir):
    rows = sharding.op7_shuffle_shards(spark, sf_dir).collect()
    docs = {r["doc_id"]: r["text"] or "" for r in table(spark, sf_dir, "documents").collect()}
    assert len(rows) == len(docs)
    for r in rows:
        raw = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert set(by) == set(range(8)) and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    again = {(r["doc_id"], r["shard"], r["slot"]) for r in sharding.op7_shuffle_shards(spark, sf_dir).collect()}
    assert again == {(r["doc_id"], r["shard"], r["slot"]) for r in rows}


def test_small_buckets_odd_and_empty(spark, odd, none, tmp_path):
    out = sharding.shuffle_shards(odd, 3, bucket_bytes=20)
    assert sorted((r["shard"], r["slot"]) for r in out.collect()) == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (2, 2), (2, 3)]
    sharding.write_shards(out, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 10
    assert sharding.shuffle_shards(none, 3).count() == 0


def test_licences_equal_sql(spark, sf_dir):
    assert_same(spark, sf_dir, licenses.op5_license_scan, licenses.OP5_SQL)


def test_licences_are_inherited_from_the_nearest_directory(spark, none):
    rows = [(1, "Released under the MIT License", None, "a/LICENSE"), (2, "Licensed under the Apache License, Version 2.0", None, "a/b/LICENSE"), (3, "code", None, "a/b/c/f"), (4, "code", None, "a/d/f"), (5, None, None, "e/f"), (6, "", None, "a/g")]
    path = F.col("source")
    got = {r["doc_id"]: (r["license"], r["how"], r["from_dir"]) for r in licenses.scan(documents(spark, rows), path=path, licence_file=F.col("source").endswith("LICENSE")).collect()}
    assert got[1][:2] == ("MIT", "header") and got[2][:2] == ("Apache-2.0", "header")
    assert got[3] == ("Apache-2.0", "inherited", "a/b") and got[4] == ("MIT", "inherited", "a")
    assert got[5] == (None, "none", None) and got[6] == ("MIT", "inherited", "a")
    assert licenses.scan(none, path=path, licence_file=F.lit(True)).count() == 0


def scanned(spark, rows):
    """rows: (doc_id, text, path) -> {doc_id: (license, cosine, how, from_dir)}; paths that say LICENSE do not matter."""
    out = licenses.scan(documents(spark, [(i, t, None, p) for i, t, p in rows]), path=F.col("source"))
    return {r["doc_id"]: (r["license"], r["cosine"], r["how"], r["from_dir"]) for r in out.collect()}


def test_licences_of_repeated_rows_are_those_of_one(spark):
    row = (1, "Released under the MIT License by Bob Smith and friends of the house near the river bank", "a/f")
    other = (2, "Licensed under the Apache License, Version 2.0", "b/g")
    rest = [(i, "nothing to see in this text", "b/f") for i in range(3, 30)]
    once, twice = scanned(spark, [row, other, *rest]), scanned(spark, [row, row, row, other, other, *rest])
    assert once[1] == twice[1] == (None, None, "none", None) and once[2] == twice[2] == ("Apache-2.0", 1.0, "header", None)


def test_whole_licence_texts_and_headers_over_lines(spark):
    text = dict((n, t) for _, n, t in licenses.TEMPLATES[len(licenses.STATEMENTS) :])
    wrap = lambda t, n: "\n".join(" ".join(t.split()[i : i + n]) for i in range(0, len(t.split()), n))
    rows = [
        (1, "MIT License\n\nCopyright (c) 2020 Bob Smith\n\n" + wrap(text["MIT"], 12), "m/any"),
        (2, "code here\n" * 50, "m/x/y/z"),
        (3, "some code\n# Released under\n# the MIT License\nmore code here and there\nand so on", "h/f"),
        (4, "It was late and all had gone home long before that. Released under the MIT License. Nobody knew why it was so quiet that night.", "h/g"),
        (5, "other text", "h/k"),
        (6, "\n".join(f"line {i} of the code" for i in range(2000)) + "\nLicensed under CC BY 4.0\n", "h/long"),
        *((i, "words of no weight in the text of a program", "q/f") for i in range(10, 40)),
    ]
    got = scanned(spark, rows)
    assert got[1][0] == "MIT" and got[1][2] == "header" and got[2] == ("MIT", got[1][1], "inherited", "m")
    assert got[3][:3] == ("MIT", 1.0, "header") and got[4][:3] == ("MIT", 1.0, "header")
    assert got[5] == (None, None, "none", None)  # a header in a longer file does not speak for the directory
    assert got[6][:3] == ("CC-BY-4.0", 1.0, "header")


CODE = "\n".join(f"    total_{i} = read(row_{i}) + offset_{i % 7}" for i in range(60))


def commented(text: str, n: int, sign: str) -> str:
    parts = text.split()
    return "\n".join(f"{sign} " + " ".join(parts[i : i + n]) for i in range(0, len(parts), n))


def test_every_licence_is_named_by_its_own_header_and_text(spark):
    """Alone, wrapped in a comment above code, and below another comment: no near relative is named."""
    rows, want = [], {}
    for i, name, text in licenses.TEMPLATES:
        forms = [text, commented(text, 11, "#") + "\n\n" + CODE, f"# Copyright 2021 Ann Example\n#\n{commented(text, 9, ' *')}\n{CODE}", CODE + "\n" + commented(text, 13, "//")]
        for j, form in enumerate(forms):
            rows.append((10 * i + j, form, f"d{i}/{j}/f"))
            want[10 * i + j] = name
    rows += [(100_000 + i, CODE, f"z/{i}") for i in range(200)]
    got = scanned(spark, rows)
    assert {k: got[k][0] for k in want} == want
    assert all(got[k] == (None, None, "none", None) for k in got if k >= 100_000)


def test_relatives_that_are_not_listed_are_not_named(spark):
    text = {n: t for _, n, t in licenses.TEMPLATES[len(licenses.STATEMENTS) :]}
    others = [
        text["LGPL-3.0"].replace("either version 3", "either version 2.1"),
        text["LGPL-3.0"].replace("Lesser", "Library").replace("either version 3", "either version 2"),
        text["GPL-2.0"].replace("either version 2", "either version 1"),
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
        "This work is licensed under a Creative Commons Attribution 3.0 Unported License.",
        text["BSD-3-Clause"].replace("3. Neither", "3. All advertising materials mentioning features or use of this software must display an acknowledgement. 4. Neither"),
    ]
    rows = [(i, t, f"d{i}/f") for i, t in enumerate(others)] + [(1000 + i, CODE, f"z/{i}") for i in range(100)]
    got = scanned(spark, rows)
    assert {i: got[i][0] for i in range(len(others))} == dict.fromkeys(range(len(others)))


def test_licences_odd(spark, odd):
    out = licenses.scan(odd, path=F.col("source"))
    assert out.count() == 10 and set(odd.columns) < set(out.columns) and out.columns.count("path") == 1


def naive_places(rows, shards: int, bucket_bytes: int, seed: int = 29) -> list[tuple]:
    """(doc_id, text, shard, slot) by the two passes in plain Python."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def scatter(doc_id, text):
        h = xxhash.xxh64_intdigest(struct.pack("<i", seed), 42)
        h = h if doc_id is None else xxhash.xxh64_intdigest(struct.pack("<q", doc_id), h)
        return signed(xxhash.xxh64_intdigest(struct.pack("<q", signed(xxhash.xxh64_intdigest((text or "").encode(), 42))), h))

    count = max(1, -(-sum(len((t or "").encode()) + 1 for _, t in rows) // bucket_bytes))
    buckets = {}
    for r in rows:
        buckets.setdefault(scatter(*r) % count, []).append((scatter(*r), r))
    out, place = [], 0
    for b in sorted(buckets):
        order = np.arange(len(buckets[b]))
        np.random.default_rng([seed, b]).shuffle(order)
        for i, (_, r) in enumerate(sorted(buckets[b], key=lambda x: x[0])):
            at = place + int(order[i])
            s = max(s for s in range(shards) if s * len(rows) // shards <= at)
            out.append((*r, s, at - s * len(rows) // shards))
        place += len(order)
    return out


def test_places_are_the_naive_shuffle(spark, odd):
    rows = [(i, f"text {i * 7919 % 101} of {i}" if i % 11 else None) for i in range(200)] + [(None, "x"), (1000, "é\U0001f600" * 50)]
    key = lambda r: (r[0] is None, r[0], r[1] or "")
    for bucket_bytes in (100, 1 << 20):
        got = sharding.shuffle_shards(documents(spark, rows), 8, bucket_bytes=bucket_bytes).select("doc_id", "text", "shard", "slot").collect()
        assert sorted(map(tuple, got), key=key) == sorted(naive_places(rows, 8, bucket_bytes), key=key)


def test_shards_of_a_large_group_of_equal_rows_are_written_in_order(spark, tmp_path):
    rows = [(1, "same")] * 3000 + [(i, f"t{i}") for i in range(2, 1000)]
    out = sharding.write_shards(sharding.shuffle_shards(documents(spark, rows), 8, bucket_bytes=2000), str(tmp_path / "s"))
    found = out.withColumn("f", F.input_file_name()).withColumn("i", F.monotonically_increasing_id()).collect()
    assert len(found) == len(rows)
    by, last = {}, {}
    for r in sorted(found, key=lambda r: r["i"]):
        assert r["place"] > last.get(r["f"], -1)
        last[r["f"]] = r["place"]
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and len(by) == 8


def test_mixing_ties_repeated_rows_and_long_texts(spark):
    rows = [(1, "w " * 7, None, "a")] * 50 + [(2, "w " * 5000, None, "a"), (3, "w " * 900, None, "b")]
    out = mixing.plan_mix(documents(spark, rows), bucket_words=100).collect()
    by = {}
    for r in out:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by.setdefault(r["source"], []).append(r)
    for rs in by.values():
        assert sum(r["taken"] for r in rs) == round(rs[0]["target"]) and rs[0]["source_size"] == sum(r["size"] for r in rs)
