"""Runs a query and its SQL on the same tables and compares the rows as multisets."""

import decimal
import math
import os

import duckdb
import numpy as np
import pandas as pd


def plain(x):
    if x is None or x is pd.NA or x is pd.NaT:
        return None
    if isinstance(x, (bool, np.bool_)):
        return bool(x)
    if isinstance(x, (int, float, np.number, decimal.Decimal)):
        return None if math.isnan(x) else round(float(x), 9)
    return str(x)


def rows(t: pd.DataFrame, columns: list[str]) -> list:
    return sorted((tuple(map(plain, r)) for r in zip(*[t[c].astype(object).tolist() for c in columns])), key=repr)


def tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in os.listdir(sf_dir):
        con.execute(f"create view {p.removesuffix('.parquet')} as select * from '{sf_dir}/{p}'")
    return con


def same(spark, sf_dir: str, query, sql: str) -> None:
    got, want = query(spark, sf_dir).toPandas(), tables(sf_dir).execute(sql).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert rows(got, columns) == rows(want, columns)
