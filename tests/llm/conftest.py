"""Documents with everything that can go wrong in them."""

from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, score string, bucket string, slot string, path string, key string, node string, id string, p string"
#: Names of the operators' results.
RESULTS = "source_size target taken positions position copies offending place shard rank weight leaf subroot root component_id fp distance errors start law".split()
SCHEMA += "".join(f", {name} string" for name in RESULTS)
CLASH = ("x",) * (9 + len(RESULTS))


def documents(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang, source); with extra columns that have the operators' own names."""
    full = [(*r, *((None, None) if len(r) == 2 else ()), None if r[1] is None else len(r[1]), *CLASH) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture
def odd(spark):
    words = " ".join(f"w{i % 97}" for i in range(60_000))
    return documents(
        spark,
        [(1, None, None, None), (2, "", "xx", ""), (3, " \t\n ", None, "a"), (4, "one", "xx", "a"), (None, "a null id has words too", None, "b"), (5, words, "yy", "b"), (6, "same text twice", "yy", None), (7, "same text twice", "yy", None), (7, "same text twice", "yy", None), (8, "\U0001f600 é ß   x", "yy", "é")],
    )


@pytest.fixture
def none(spark):
    return documents(spark, [])
