"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import numpy as np
import pytest

from lumigrid.plans.catalogue import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def _ordered(df):
    df = df[sorted(df.columns)]
    key = df.map(lambda v: f"{v:.3f}" if isinstance(v, float) else str(v)) if len(df) else df
    return df.loc[key.sort_values(list(df.columns)).index].reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    got = QUERIES[name](spark, sf).toPandas()
    assert len(got.columns) == len(set(got.columns))
    if name not in ORACLES:
        assert len(got)
        return
    want = con.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    got, want = _ordered(got), _ordered(want)
    assert len(got) == len(want)
    for c in got.columns:
        if got[c].dtype.kind == "f" or want[c].dtype.kind == "f":
            np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), atol=2e-5, rtol=0)
        else:
            assert got[c].astype(str).tolist() == want[c].astype(str).tolist()
