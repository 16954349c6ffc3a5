"""Rows of a query and of its SQL, as sorted lists."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    if v is None or str(v) in ("NaT", "None", "<NA>"):
        return None
    return v if isinstance(v, (int, str, bool)) else str(v)


def rows(frame) -> tuple[list[str], list[str]]:
    names = sorted(frame.columns)
    return names, sorted(repr(tuple(plain(v) for v in r)) for r in frame[names].astype(object).itertuples(index=False))


def of_sql(sql: str, sf_dir: str):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return rows(con.sql(sql).df())


def check(query, sql: str, spark, sf_dir: str) -> None:
    got, want = rows(query(spark, sf_dir).toPandas()), of_sql(sql, sf_dir)
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert [x for x in zip(got[1], want[1], strict=True) if x[0] != x[1]][:3] == []
