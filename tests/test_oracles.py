"""Every query with an oracle, side by side with DuckDB."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
ORACLES = entry.registry.ORACLES
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


def kind(series):
    some = series.dropna()
    if not len(some):
        return None
    return {"i": "int", "u": "int", "f": "float", "b": "bool"}.get(some.infer_objects().dtype.kind, "text")


def ordered(df):
    df = df[sorted(df.columns)]
    key = df.apply(lambda s: s.map(lambda v: "" if pd.isna(v) else f"{v:.6g}" if isinstance(v, (int, float, np.number)) and not isinstance(v, bool) else str(v)))
    return df.iloc[np.lexsort([key[c] for c in reversed(key.columns)])].reset_index(drop=True) if len(df) else df


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, duck, name):
    got, want = entry.registry.QUERIES[name](spark, FOLDER).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    got, want = ordered(got), ordered(want)
    for c in got.columns:
        a, b = got[c], want[c]
        assert (a.isna() == b.isna()).all(), c
        ka, kb = kind(a), kind(b)
        assert ka == kb or None in (ka, kb) or {ka, kb} == {"int", "float"} and (a.isna().any() or b.isna().any()), (c, ka, kb)
        if ka == "float" or kb == "float":
            assert np.allclose(a.dropna().astype(float), b.dropna().astype(float), rtol=1e-9, atol=1e-6), c
        else:
            assert (a.dropna().astype(str) == b.dropna().astype(str)).all(), (c, a[a.astype(str) != b.astype(str)].head(), b[a.astype(str) != b.astype(str)].head())


def test_every_query_has_rows(spark):
    for name in sorted(set(entry.registry.QUERIES) - set(ORACLES)):
        assert entry.registry.QUERIES[name](spark, FOLDER).count() > 0, name


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 100 and all(1000 <= r.o_totalprice <= 50000 for r in rows)
