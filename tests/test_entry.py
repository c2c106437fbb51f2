"""Every query with SQL gives the SQL's rows at the smallest scale."""

import math
from pathlib import Path

import duckdb
import pytest

from mirrorframe.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    if not Path(SF).exists():
        pytest.skip("no test data")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def _rows(df):
    df = df[sorted(df.columns)]
    clean = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else v
    return list(df.columns), sorted(str(tuple(clean(v) for v in r)) for r in df.astype(object).where(df.notna(), None).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, duck, name):
    assert _rows(QUERIES[name](spark, SF).toPandas()) == _rows(duck.sql(ORACLES[name]).df())


def test_entry_imports():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
