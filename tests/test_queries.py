"""Each registered query against its SQL in DuckDB."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import tilewright.plans.files
import tilewright.plans.more
import tilewright.plans.reports  # noqa: F401 - they register their queries
from tilewright.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    plain = lambda x: None if pd.isna(x) else float(x) if isinstance(x, (int, float)) or getattr(getattr(x, "dtype", None), "kind", "") in "iuf" and hasattr(x, "dtype") else x
    return sorted((tuple(plain(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
