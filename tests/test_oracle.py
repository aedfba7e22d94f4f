"""Queries against the same rows in DuckDB, on the smallest tables."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from quire import catalog

DIR = "/root/testdata/sf0.001"


def _cell(v):
    if v is None or v is pd.NA or v != v:
        return "null"
    if isinstance(v, str):
        return v
    if str(type(v)).find("bool") >= 0:
        return str(bool(v))
    return repr(round(float(v), 9)) if not hasattr(v, "isoformat") else str(v)


@pytest.mark.skipif(not Path(DIR).exists(), reason="no test data")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_duckdb(spark, name):
    c = duckdb.connect()
    for p in Path(DIR).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    got = catalog.queries()[name](spark, DIR).toPandas()
    want = c.sql(catalog.oracle_sql()[name]).fetchdf()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda df: sorted(tuple(_cell(v) for v in r) for r in df[columns].astype(object).itertuples(index=False))
    assert rows(got) == rows(want)


@pytest.mark.skipif(not Path(DIR).exists(), reason="no test data")
@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, DIR).count() > 0
