"""Learned operators against labels they have not seen."""

from __future__ import annotations

import math
from collections import Counter

import pytest
from conftest_path import documents, table
from pyspark.sql import functions as F

from spanlock.llm import language_id, toxicity

SF = "/root/testdata/sf0.1"


def test_toxicity_of_held_out_documents(spark):
    rows = toxicity.op3_toxicity(spark, SF).where("held_out").join(table(spark, SF, "labels"), "doc_id").select("score", "toxic").collect()
    good, bad = [r["score"] for r in rows if not r["toxic"]], [r["score"] for r in rows if r["toxic"]]
    assert sum(s < 0.5 for s in good) / len(good) > 0.97
    assert sum(s >= 0.5 for s in bad) / len(bad) > 0.8


def test_offending_sentences_hold_the_planted_one(spark):
    calm, foul = "The garden was quiet in the morning.", "You vile grobnak swine."
    rows = [(i, f"{calm} Number {i} came. {foul if i % 2 else calm} It was late.") for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    docs = documents(spark, rows)
    out = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert all((r["score"] >= 0.5) == bool(r["doc_id"] % 2) for r in out)
    assert all("grobnak" in " ".join(r["text"][s["start"] : s["stop"]] for s in r["offending"]) for r in out if r["doc_id"] % 2)


def test_toxicity_odd_and_empty(spark, odd, none):
    labels = spark.createDataFrame([(4, 0), (6, 1), (6, 0), (None, 1), (99, None)], "doc_id long, toxic int")
    model = toxicity.fit(odd, labels)
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == 10 and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score(none, model).count() == 0
    alone = toxicity.fit(odd, labels.where("toxic = 0"))
    assert all(r["score"] < 0.5 for r in toxicity.score(odd, alone).collect())


def test_language_of_held_out_documents(spark):
    rows = language_id.op6_language_id(spark, SF).where("held_out").join(table(spark, SF, "documents").where("lang is not null and length(text) > 20").select("doc_id", "lang"), "doc_id")
    r = rows.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("ok")).first()
    assert r["ok"] > 0.98


def test_language_odd_and_empty(spark, odd, none):
    model = language_id.fit(odd)
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in language_id.predict(odd, model, keep=["doc_id"]).collect()]
    assert len(got) == 10 and all(0 <= s <= 1 for _, _, s in got)
    assert {d for d, lang, _ in got if lang == "und"} == {1, 2, 3}
    assert language_id.predict(none, model, keep=["doc_id"]).count() == 0
    nothing = language_id.fit(none)
    assert {r["lang_pred"] for r in language_id.predict(odd, nothing, keep=["doc_id"]).collect()} == {"und"}


def test_signs_beyond_the_first_plane_are_no_letters(spark):
    from spanlock.llm.ngrams import codes_of

    # emoji, a mathematical sign and a Gothic letter; Deseret capital to small
    assert codes_of("a\U0001f600\U0001d6c1\U00010330").tolist() == [97, 32, 32, 0x10330]
    assert codes_of("\U00010400\U00020000").tolist() == [0x10428, 0x20000]
    model = language_id.fit(documents(spark, [(1, "the cat sat", "en", None), (2, "die Katze lag", "de", None)]))
    docs = documents(spark, [(3, "\U0001f600 \U0001f601\U0001f680"), (4, "\U0001f600 the cat")])
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(docs, model, keep=["doc_id"]).collect()}
    assert got[3] == ("und", 0.0) and got[4][0] == "en"


def naive_codes(text: str) -> list[int]:
    out = []
    for c in text:
        low = c.lower()
        out.append((ord(low) if len(low) == 1 else ord(c)) if c.isalpha() else 10 if c in "\n.!?" else 32)
    return out


def naive_bucket(codes: list[int], bits: int) -> int:
    h = len(codes) * 0x9E3779B1 & 0xFFFFFFFF
    for c in codes:
        h = (h ^ c) * 0x85EBCA6B & 0xFFFFFFFF
        h ^= h >> 15
    return h >> (32 - bits)


def test_document_scores_are_the_naive_noisy_or(spark):
    calm, foul = "The garden was quiet in the morning.", "You vile grobnak swine!"
    texts = [f"{calm} Number {i} came. {foul if i % 2 else calm}\nIt was late" for i in range(60)] + ["grobnak", "...", "é ß \U0001f600 vile", foul + " " + foul]
    docs = documents(spark, [*enumerate(texts)])
    model = toxicity.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int"))
    assert model.weights.any()

    def naive(text: str) -> float:
        sentences: list[list[int]] = [[]]
        for c in naive_codes(f" {text} "):
            sentences[-1].append(c)
            if c == 10:
                sentences.append([])
        clean = 1.0
        for s in filter(None, sentences):
            s = [32 if c == 10 else c for c in s]
            z = model.bias
            for k, n in enumerate(toxicity.ORDERS):
                for i in range(len(s) - n + 1):
                    z += float(model.weights[naive_bucket(s[i : i + n], toxicity.BITS) + (k << toxicity.BITS)])
            clean *= 1 - 1 / (1 + math.exp(-z))
        return 1 - clean

    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    for i, text in enumerate(texts):
        assert got[i] == pytest.approx(naive(text), abs=1e-6), text


def test_language_scores_are_the_naive_sums(spark):
    known = {"en": ["the cat sat on the mat", "a dog and the cat"], "de": ["die Katze lag da", "der Hund und die Katze"], "el": ["η γάτα"]}
    rows = [(i, t, lang, None) for i, (lang, t) in enumerate((lang, t) for lang, ts in known.items() for t in ts)]
    texts = ["the dog sat", "die Hunde", "γάτα the", "x", "Straße und"]

    def grams(text: str):
        codes = naive_codes(text)
        for n in language_id.ORDERS:
            for i in range(len(codes) - n + 1):
                if any(c > 32 for c in codes[i : i + n]):
                    yield naive_bucket(codes[i : i + n], language_id.BITS)

    logs = {}
    for lang, ts in known.items():
        counts = Counter(g for t in ts for g in grams(t))
        total = sum(counts.values()) + 0.5 * (1 << language_id.BITS)
        logs[lang] = lambda g, counts=counts, total=total: math.log((counts[g] + 0.5) / total)
    model = language_id.fit(documents(spark, rows))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(documents(spark, [*enumerate(texts)]), model, keep=["doc_id"]).collect()}
    for i, text in enumerate(texts):
        sums = {lang: sum(map(log, grams(text))) for lang, log in logs.items()}
        best = max(sorted(sums), key=sums.get)
        assert got[i][0] == best and got[i][1] == pytest.approx(1 / sum(math.exp(s - sums[best]) for s in sums.values()), abs=1e-3), text
