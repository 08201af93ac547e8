"""Every registered query against its SQL over the smallest tables, where those tables are there."""

import glob
import os

import duckdb
import pytest

from lattica import queries

FOLDER = os.environ.get("LATTICA_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got, want = queries.queries()[name](spark, FOLDER).toPandas(), duck.sql(queries.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns) and len(got) == len(want)
    key = lambda rows: sorted(rows, key=repr)
    tuples = lambda df: key([tuple(None if v is None or v != v else float(v) if isinstance(v, int | float) else str(v) for v in row) for row in df[cols].astype(object).where(df[cols].notna(), None).itertuples(index=False)])
    assert tuples(got) == tuples(want)
