"""Comparison of a query with its SQL, as rows in any order."""

from pathlib import Path

import duckdb
import pandas as pd

DATA = "/root/testdata/sf0.001"


def connect(folder: str = DATA):
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def text(v) -> str:
    if type(v).__name__ in ("bool", "bool_"):
        return repr(bool(v))
    if isinstance(v, (list, str)):
        return repr(v)
    if v is None or v is pd.NaT or v is pd.NA or v != v:
        return "none"
    return repr(float(v)) if isinstance(v, (int, float)) or hasattr(v, "dtype") else repr(v)


def rows(df: pd.DataFrame) -> list[str]:
    df = df[sorted(df.columns)]
    return sorted("|".join(map(text, r)) for r in df.itertuples(index=False, name=None))


def same(spark, query, sql: str) -> None:
    got, want = query(spark, DATA).toPandas(), connect().sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
