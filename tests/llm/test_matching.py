"""Operators on pairs of texts against brute force."""

from __future__ import annotations

import random

import xxhash
from conftest_path import documents, groups, table
from hypothesis import given, settings
from hypothesis import strategies as st

from spanlock.llm import decontamination, iblt, simhash

VOCABULARY = [f"word{i}" for i in range(400)]


def prose(r: random.Random, n: int) -> list[str]:
    return [r.choice(VOCABULARY) for _ in range(n)]


def edit_distance_within(item: str, text: str) -> int:
    """The smallest edit distance of the item to a part of the text (Sellers)."""
    column = list(range(len(item) + 1))
    best = column[-1]
    for c in text:
        last, column[0] = column[0], 0
        for i, x in enumerate(item, 1):
            last, column[i] = column[i], min(column[i] + 1, column[i - 1] + 1, last + (x != c))
        best = min(best, column[-1])
    return best


def edit_distance_from_here(item: str, text: str) -> int:
    """The smallest edit distance of the item to a part at the beginning of the text."""
    column = list(range(len(item) + 1))
    best = column[-1]
    for j, c in enumerate(text, 1):
        last, column[0] = column[0], j
        for i, x in enumerate(item, 1):
            last, column[i] = column[i], min(column[i] + 1, column[i - 1] + 1, last + (x != c))
        best = min(best, column[-1])
    return best


@given(st.text("abc", min_size=1, max_size=12), st.text("abc", max_size=30))
@settings(max_examples=200, deadline=None)
def test_myers_is_the_edit_distance(item, text):
    assert decontamination.myers(decontamination.masks(item), len(item), text)[0] == edit_distance_within(item, text)


def test_contaminated_is_brute_force(spark):
    r = random.Random(5)
    items = [" ".join(prose(r, 8)) for _ in range(6)]
    texts = []
    for i in range(40):
        item = list(items[i % 6])
        for _ in range(r.randrange(7)):
            at = r.randrange(len(item))
            item[at : at + 1] = r.choice([[], ["x"], [item[at], "y"]])
        texts.append(" ".join(prose(r, 5)) + " " + "".join(item) + " " + " ".join(prose(r, 5)))
    docs = documents(spark, [*enumerate(texts), (100, None), (101, ""), (102, items[0].upper())])
    bench = spark.createDataFrame([*enumerate(items), (50, None), (51, " ")], "item_id long, text string")
    for block_chars in (1 << 20, 60):
        got = {(x["doc_id"], x["item_id"], x["distance"]) for x in decontamination.contaminated(docs, bench, block_chars=block_chars).collect()}
        want = {(d, i, e) for d, t in [*enumerate(texts), (102, items[0])] for i, item in enumerate(items) if (e := edit_distance_within(item, t)) <= len(item) // 16}
        assert got == want
    of = dict(enumerate(texts)) | {102: items[0]}
    for x in decontamination.contaminated(docs, bench).collect():
        assert edit_distance_from_here(items[x["item_id"]], of[x["doc_id"]][x["start"] :]) == x["distance"]
    assert decontamination.contaminated(docs.limit(0), bench).count() == 0
    assert decontamination.contaminated(docs, bench.limit(0)).count() == 0


def test_items_without_an_edit_are_whole_words(spark):
    docs = documents(spark, [(1, "concatenate the words"), (2, "a cat"), (3, "Cat, and so on"), (4, "bobcat"), (5, "cat"), (5, "cat"), (6, "x " * 30_000 + "cat " + "y " * 30_000)])
    bench = spark.createDataFrame([(7, "cat"), (7, "cat"), (8, "the word")], "item_id long, text string")
    got = sorted((x["doc_id"], x["item_id"], x["start"]) for x in decontamination.contaminated(docs, bench).collect())
    assert got == sorted([(2, 7, 2), (3, 7, 0), (5, 7, 0), (5, 7, 0), (6, 7, 60_000)] * 2)


def fingerprint(text: str | None) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_components_are_brute_force(spark, sf_dir):
    docs = sorted(table(spark, sf_dir, "documents").select("doc_id", "text").collect(), key=lambda r: r["doc_id"])
    fps = [fingerprint(r["text"]) for r in docs]
    root = groups(len(docs), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op9_simhash_components(spark, sf_dir).collect()}
    assert got == {r["doc_id"]: (f"{fps[i]:016x}", docs[root[i]]["doc_id"]) for i, r in enumerate(docs)}


def test_very_many_copies_are_one_component(spark):
    rows = [(i, None if i % 3 == 0 else " ") for i in range(3000)] + [(None, None), (5000, "alone among all others"), (None, "a text without an id")]
    got = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(documents(spark, rows)).collect()}
    assert got == {(i, 0) for i in range(3000)} | {(None, 0), (5000, 5000), (None, None)}


def test_links_lose_none_on_dense_fingerprints(spark):
    r = random.Random(3)
    values = {0}
    for _ in range(150):
        x = r.choice(sorted(values))
        for _ in range(r.randrange(1, 4)):
            x ^= 1 << r.randrange(64)
        values.add(x)
    values = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    roots = simhash.components(simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"))).collect()
    of = {x["node"]: x["root"] for x in roots}
    want = groups(len(values), lambda i, j: ((values[i] ^ values[j]) & (1 << 64) - 1).bit_count() <= 2)
    assert [of.get(v, v) for v in values] == [values[w] for w in want]


def test_a_row_alone_at_the_root_names_its_component(spark):
    r = random.Random(5)
    base = prose(r, 2000)
    first = simhash.fingerprint_of(" ".join(base).encode().split(), 3)
    near = next(t for t in (" ".join(base[:i] + ["changed"] + base[i + 1 :]) for i in range(2000)) if 1 <= ((simhash.fingerprint_of(t.encode().split(), 3) ^ first) & (1 << 64) - 1).bit_count() <= 2)
    for texts in ((" ".join(base), near), (near, " ".join(base))):  # the smaller id at either end of the link
        got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(documents(spark, [*enumerate(texts, 1), (9, "alone")])).collect()}
        assert got == {1: 1, 2: 1, 9: 9}


def test_components_list_their_roots(spark):
    rows = simhash.components(spark.createDataFrame([(3, 2), (5, 3), (9, 8)], "a long, b long")).collect()
    assert sorted(map(tuple, rows)) == [(2, 2), (3, 2), (5, 2), (8, 8), (9, 8)]


def test_keep_one_is_brute_force(spark):
    r = random.Random(11)
    texts = []
    for i in range(60):
        if i % 3 == 0:
            base = prose(r, r.randrange(60, 300))
        text = list(base)
        for _ in range(r.choice([0, 1, 1, 2])):
            text[r.randrange(len(text))] = "changed"
        texts.append(" ".join(text))
    rows = list(enumerate(texts))
    sets = [{tuple(t.lower().split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    root = groups(60, lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    r.shuffle(rows)
    assert {x["doc_id"] for x in simhash.keep_one(documents(spark, rows)).collect()} == set(root)


def kept_by_brute_force(texts: list[str]) -> set[int]:
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := t.lower().split()) else set() for t in texts]
    return set(groups(len(texts), lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])))


def test_keep_one_finds_short_texts(spark):
    r = random.Random(19)
    texts = []
    for n in range(9, 61):
        base = [f"w{r.randrange(10**6)}" for _ in range(n)]
        extra = [f"w{r.randrange(10**6)}" for _ in range(max(1, n // 12))]
        at = r.randrange(n)
        texts += [" ".join(base), " ".join(base + extra), " ".join(extra + base), " ".join(base[:at] + ["changed"] + base[at + 1 :])]
    want = kept_by_brute_force(texts)
    assert len(want) < len(texts) // 2
    assert {x["doc_id"] for x in simhash.keep_one(documents(spark, [*enumerate(texts)])).collect()} == want


def test_keep_one_finds_copies_in_a_shared_passage(spark):
    r = random.Random(23)
    own = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    passage = own(60)
    for _ in range(2):
        texts = [" ".join(own(40) + passage + own(40)) for _ in range(150)] + [" ".join(own(3) + passage + own(3)) for _ in range(8)]
        r.shuffle(texts)
        want = kept_by_brute_force(texts)
        assert len(want) == 151
        assert {x["doc_id"] for x in simhash.keep_one(documents(spark, [*enumerate(texts)])).collect()} == want


def test_keep_one_compares_sets_of_shingles(spark):
    r = random.Random(29)
    texts = []
    for _ in range(20):
        base, line = [[f"w{r.randrange(10**6)}" for _ in range(n)] for n in (200, 12)]
        texts += [" ".join(base + line), " ".join(base + line * 40)]
    want = kept_by_brute_force(texts)
    assert len(want) == 20
    assert {x["doc_id"] for x in simhash.keep_one(documents(spark, [*enumerate(texts)])).collect()} == want


def test_near_duplicates_odd_and_empty(spark, odd, none):
    rows = {(x["doc_id"], x["component_id"]) for x in simhash.near_duplicates(odd).collect()}
    assert {(1, 1), (2, 1), (3, 1), (6, 6), (7, 6)} <= rows
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert {x["doc_id"] for x in kept.collect()} == {1, 4, None, 5, 6, 8}
    assert simhash.keep_one(none).count() == 0


def test_likeness_is_the_jaccard_similarity(spark):
    r = random.Random(2)
    rows = []
    for i in range(30):
        left = [f"Line {r.randrange(10**6)} here." for _ in range(r.choice([0, 1, 3, 20, 150]))]
        right = [x for x in left if r.random() < 0.8] + [f"Other {r.randrange(10**6)}." for _ in range(r.choice([0, 1, 5, 60]))]
        rows.append((i, "\n".join(left), "\n".join(right)))
    df = spark.createDataFrame(rows, "i long, l string, r string").withColumn("a", iblt.digests("l")).withColumn("b", iblt.digests("r"))
    df = df.selectExpr("*", f"{iblt.sketch('a')} as ca", f"{iblt.sketch('b')} as cb")
    got = {x["i"]: x["s"] for x in df.select("i", iblt.likeness("a", "ca", "b", "cb").alias("s")).collect()}
    for i, left, right in rows:
        x, y = set(filter(None, left.split("\n"))), set(filter(None, right.split("\n")))
        assert abs(got[i] - (len(x & y) / len(x | y) if x | y else 1.0)) < 1e-9


def test_recovered_digests_are_the_differing_ones(spark):
    r = random.Random(4)
    rows = []
    for i in range(30):
        left = [f"Line {r.randrange(10**6)} here." for _ in range(r.choice([0, 1, 3, 20, 150]))]
        right = [x for x in left if r.random() < 0.8] + [f"Other {r.randrange(10**6)}." for _ in range(r.choice([0, 1, 5, 60]))]
        rows.append((i, "\n".join(left), "\n".join(right)))
    df = spark.createDataFrame(rows, "i long, l string, r string").withColumn("a", iblt.digests("l")).withColumn("b", iblt.digests("r"))
    df = df.selectExpr("*", f"{iblt.sketch('a')} as ca", f"{iblt.sketch('b')} as cb")
    for x in df.select("a", "b", iblt.recovered("a", "ca", "b", "cb").alias("d")).collect():
        assert (sorted(x["d"]["only_left"]), sorted(x["d"]["only_right"])) == (sorted(set(x["a"]) - set(x["b"])), sorted(set(x["b"]) - set(x["a"])))


def test_fingerprints_odd_and_empty(spark, odd, none, tmp_path):
    for name, df, n in (("odd", odd, 10), ("none", none, 0)):
        df.write.parquet(str(tmp_path / name / "documents.parquet"))
        rows = iblt.op10_iblt_fingerprints(spark, str(tmp_path / name)).collect()
        assert len(rows) == n and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
        assert len({r["fingerprint"] for r in rows if r["doc_id"] in (1, 2, 3)}) <= 1
        assert len({r["fingerprint"] for r in rows if r["doc_id"] in (6, 7)}) <= 1


def test_next_row_over_many_runs(spark, monkeypatch):
    monkeypatch.setattr(iblt, "RUN_ROWS", 16)
    rows = [(i * 3, f"t{i}") for i in range(200)] + [(None, f"n{i}") for i in range(100)] + [(9, "again")] * 40
    got = iblt.with_next(documents(spark, rows), {"n": "text"}).select("doc_id", "text", "n").collect()
    assert len(got) == len(rows)
    order = [r["text"] for r in got if r["doc_id"] is not None and r["doc_id"] > 9]
    assert all(r["n"] == (f"t{r['doc_id'] // 3 + 1}" if r["doc_id"] < 597 else r["n"]) for r in got if r["doc_id"] is not None and r["doc_id"] > 9) and len(order) == 196
    last = next(r["n"] for r in got if r["doc_id"] == 597)
    assert last.startswith("n") and {r["n"] for r in got if r["doc_id"] is None} == {f"n{i}" for i in range(100)} - {last} | {"t0"}


def test_fingerprints_of_edited_texts(spark, sf_dir):
    import hashlib

    docs = sorted(((r["doc_id"], r["text"] or "") for r in table(spark, sf_dir, "documents").collect()))
    got = {r["doc_id"]: r for r in iblt.op10_iblt_fingerprints(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    seen = {}
    for i, (doc, text) in enumerate(docs):
        n = len(text) // 4
        edited = text[: len(text) - n] + docs[(i + 1) % len(docs)][1][:n]
        assert got[doc]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert got[doc]["n_chars"] == len(text) and 0 <= got[doc]["near_next"] <= 1
        assert seen.setdefault(text, got[doc]["fingerprint"]) == got[doc]["fingerprint"]
        assert edited != text or got[doc]["near_edited"] == 1.0


def test_next_row_odd_and_empty(spark, odd, none):
    got = [(r["doc_id"], r["n"]) for r in iblt.with_next(odd, {"n": "doc_id"}).collect()]
    assert len(got) == 10 and (8, None) in got and (5, 6) in got
    assert iblt.with_next(none, {"n": "doc_id"}).count() == 0
