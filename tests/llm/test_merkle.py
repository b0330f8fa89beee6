from __future__ import annotations

import hashlib
import zlib

from conftest_path import documents
from oracle import assert_same
from pyspark.sql import functions as F

from spanlock.llm import merkle

LOWER = {c: c + 32 for c in range(65, 91)}


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(nodes, fan):
    out = [list(nodes)]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + fan]) for i in range(0, len(out[-1]), fan)])
    return out


def proof(tree, i, fan):
    for level in tree[:-1]:
        run = level[i // fan * fan : i // fan * fan + fan]
        yield run[: i % fan], run[i % fan + 1 :]
        i //= fan


def naive(rows, fan=8):
    """rows: (doc_id, text, lang, source, n_chars). The contract's columns in plain Python."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: h(*map(field, (r[0], r[3], r[2], r[4], text)))
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    names = sorted(by, key=lambda k: (k is not None, (k or "").encode()))
    trees = {k: levels([x[2] for x in sorted(by[k], key=lambda x: x[:3])], fan) for k in names}
    top = levels([trees[k][-1][0] for k in names], fan)
    out = []
    for k in names:
        for i, (_, _, own, r) in enumerate(sorted(by[k], key=lambda x: x[:3])):
            path = [*proof(trees[k], i, fan), *proof(top, names.index(k), fan)]
            crc = zlib.crc32(("" if r[0] is None else str(r[0])).encode())
            digest = leaf(r, r[1].translate(LOWER)) if crc % 3 == 0 and r[1] is not None else own
            for left, right in path:
                digest = h(*left, digest, *right)
            out.append((r[0], own, trees[k][-1][0], top[-1][0], h(*(x for left, right in path for x in left + right)), digest, digest == top[-1][0]))
    return sorted(out, key=str)


def got(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = merkle.op12_merkle_manifest(spark, str(tmp_path))
    return sorted(map(tuple, rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


def plain(docs):
    return [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]


def test_op12_equals_sql(spark, sf_dir):
    assert_same(spark, sf_dir, merkle.op12_merkle_manifest, merkle.OP12_SQL)


def test_odd_rows_and_runs_of_one(spark, odd, tmp_path):
    """Groups of 9 and 65 leaves end in runs of one on one and two levels; ten groups make two levels of subroots."""
    more = [(1000 + i, f"Text {i}", "nine", "s") for i in range(9)] + [(2000 + i, f"TEXT {i}", "é65", "s") for i in range(65)] + [(3000 + i, "A", f"l{i}", None) for i in range(6)]
    docs = odd.unionByName(documents(spark, more))
    assert got(spark, docs, tmp_path) == naive(plain(docs))


def test_low_levels_by_shuffle_are_the_same(spark, monkeypatch, tmp_path):
    docs = documents(spark, [(i, f"Document {i}", "aa" if i % 3 else None, "s") for i in range(700)])
    monkeypatch.setattr(merkle, "BROADCAST_ROWS", 100)
    assert got(spark, docs, tmp_path) == naive(plain(docs))


def test_another_fan_and_extra_columns(spark):
    rows = documents(spark, [(i, "x", None, None) for i in range(30)]).withColumns({"grp": F.lit("="), "leaf": F.sha2(F.col("doc_id").cast("string"), 256)})
    out = merkle.manifest(rows, [F.col("doc_id")], fan=3).collect()
    tree = levels([h(str(i)) for i in range(30)], 3)
    assert {r["root"] for r in out} == {tree[-1][0]} and len(out) == 30 and "p" in out[0].asDict()
    assert all([(p["run"][: p["slot"]], p["run"][p["slot"] + 1 :]) for p in r["path"]] == list(proof(tree, r["doc_id"], 3)) for r in out)


def test_no_documents(spark, none, tmp_path):
    assert got(spark, none, tmp_path) == []
