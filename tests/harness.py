"""Run a query and its SQL side by side and compare rows, types aside."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def duck(sql: str, sf_dir: str = SF) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    found = con.execute(sql)
    columns = [c[0] for c in found.description]
    return columns, found.fetchall()


def compare(spark, name: str, query, sql: str, sf_dir: str = SF) -> int:
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    columns, rows = duck(sql, sf_dir)
    assert sorted(columns) == sorted(df.columns), (name, sorted(columns), sorted(df.columns))
    want = rows_of(columns, rows)
    assert len(got) == len(want), (name, len(got), len(want))
    odd = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    assert not odd, (name, len(odd), odd[:3])
    return len(got)
