"""Every registered query against the same question in DuckDB, on the smallest scale."""

import math
import os

import duckdb
import pytest

from __spark_entry__ import entry
from umbral.plans.catalogue import ORACLES, QUERIES

FOLDER = os.environ.get("UMBRAL_TEST_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return int(v) if v == int(v) and abs(v) < 1e15 else v
    return v


def sort_key(row):
    return tuple((v is None, str(v)) for v in row)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    cols = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=sort_key)
    got = duck.execute(ORACLES[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in got.fetchall()), key=sort_key)
    assert ours == theirs


#: Rows of the grids: three for every fit, whether it can be solved or not.
GRID_ROWS = {"rd_covariates_grid": 105, "rd_balance_grid": 33, "rd_size_grid": 72}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    out = QUERIES[name](spark, FOLDER).collect()
    assert len(out) == GRID_ROWS[name] if name in GRID_ROWS else out
    if name in GRID_ROWS:
        assert all((r["estimate"] is None) == (r["reason"] is not None) for r in out)


def test_entry(spark):
    df = entry(spark)
    assert df.columns[0] == "bin" and df.count() > 0
