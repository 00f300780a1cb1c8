"""Every registered query with SQL against DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from rasterloom import queries

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{FOLDER}/{t}.parquet')")
    return con


def rows(frame):
    columns = sorted(frame.columns)
    text = frame[columns].astype(object).map(lambda v: "null" if v is None or v is pd.NA or v != v else f"{v:.9g}" if isinstance(v, float) else str(v))
    return columns, text.sort_values(columns, ignore_index=True)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, FOLDER).toPandas()
    assert len(got)
    if name in queries.SQL:
        (a, x), (b, y) = rows(got), rows(duck.sql(queries.SQL[name]).df())
        assert a == b and x.equals(y)
