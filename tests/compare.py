"""Runs a registered query and its SQL on the same tables and compares them."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def duck(sf_dir: str = SF) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        at = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{at}'")
    return con


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]

    def cell(v):
        if hasattr(v, "tolist"):
            v = v.tolist()
        if isinstance(v, (list, tuple)):
            return "[" + ",".join(cell(x) for x in v) + "]"
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "null"
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, (int, float)):
            return repr(float(v))
        return str(v)

    return sorted(tuple(cell(v) for v in r) for r in frame.itertuples(index=False, name=None))


def assert_same(got: pd.DataFrame, want: pd.DataFrame, name: str = "") -> None:
    assert sorted(got.columns) == sorted(want.columns), (name, sorted(got.columns), sorted(want.columns))
    a, b = rows(got), rows(want)
    assert len(a) == len(b), (name, len(a), len(b))
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    assert not bad, (name, len(bad), bad[:3])
