"""Comparing a query with its SQL in DuckDB."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _value(v):
    return f"{v:.6g}" if isinstance(v, float) else str(v)


def rows_of(df) -> tuple[list[str], list[tuple]]:
    columns = sorted(df.columns)
    plain = df[columns].astype(object).where(df[columns].notna(), None)
    return columns, sorted(tuple(_value(v) for v in row) for row in plain.itertuples(index=False))


def assert_same(spark, sf_dir: str, query, sql: str) -> None:
    ours = rows_of(query(spark, sf_dir).toPandas())
    theirs = rows_of(connection(sf_dir).execute(sql).df())
    assert ours[0] == theirs[0]
    assert len(ours[1]) == len(theirs[1])
    assert ours[1] == theirs[1]
