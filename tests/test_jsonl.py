"""JSON lines in byte ranges."""

from __future__ import annotations

import hashlib

import pytest

from spanlock.sources import jsonl as J

h = lambda s: hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


def tree(lines, size):
    level = [h(x) for x in lines]
    while True:
        level = [h("".join(level[i : i + size])) for i in range(0, len(level), size)]
        if len(level) <= 1:
            return level[0] if level else h("")


@pytest.fixture
def small_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("end", ["", "\n"])
def test_rows_follow_the_files_in_any_ranges(spark, tmp_path, small_ranges, end):
    lines = [f'{{"i":{i},"t":"{"é" * (i % 50)}"}}' + ("\r" if i % 9 == 0 else "") for i in range(700)]
    (tmp_path / "a.jsonl").write_bytes(("\n".join(lines[:500]) + end).encode())
    (tmp_path / "b.jsonl").write_bytes(("\n".join(lines[500:]) + end).encode())
    path = str(tmp_path)
    df = J.numbered(spark, path)
    assert df.rdd.getNumPartitions() > 20
    assert [r["line"] for r in df.orderBy("row_index").collect()] == lines
    assert sorted(r["row_index"] for r in df.collect()) == list(range(700))
    found = J.facts(spark, path, 16)
    assert found == J.Facts(sum(len(x.encode()) + 1 for x in lines) - (0 if end else 2), 700, tree(lines, 16))
    assert J.facts(spark, path).digest == tree(lines, J.BLOCK)


def test_verification_names_what_differs(spark, tmp_path):
    path = str(tmp_path / "x.jsonl")
    put = lambda text: open(path, "w").write(text)
    put('{"a":1}\n{"a":2}\n')
    known = J.facts(spark, path)
    assert J.verify(spark, path, known) == known
    for text, match in (('{"a":1}\n{"a":2}\n\n', "bytes"), ('{"a":1}\n{"a":3}\n', "digest"), ('{"a":2}\n{"a":1}\n', "digest"), ('{"a":1}\n{"a":\n}\n', "rows"), ('{"a":1}\n{"a":2}', "bytes")):
        put(text)
        with pytest.raises(J.SourceError, match=match):
            J.verify(spark, path, known)
    put("")
    assert J.facts(spark, path) == J.Facts(0, 0, h(""))


def test_scan_is_strict_and_keeps_the_order(spark, tmp_path):
    path = str(tmp_path / "x.jsonl")
    open(path, "w").write('{"a":1,"b":"x"}\n{"a":2}\n{"b":"z","a":3}')
    assert [tuple(r) for r in J.scan(spark, path, "a long, b string").orderBy("row_index").collect()] == [(0, 1, "x"), (1, 2, None), (2, 3, "z")]
    for bad in ('{"a":1}\n{"a":"no"}', '{"a":1}\nnot json', '{"a":1}\n\n{"a":2}', '{"a":1}\n[1]'):
        open(path, "w").write(bad)
        with pytest.raises(Exception, match="row 1 is not an object"):
            J.scan(spark, path, "a long").collect()
