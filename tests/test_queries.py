"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from sluice.plans import queries as q
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(df: pd.DataFrame) -> list:
    one = lambda v: None if pd.api.types.is_scalar(v) and pd.isna(v) else round(float(v), 6) if isinstance(v, (int, float, bool)) or hasattr(v, "dtype") and v.dtype.kind in "iufb" else str(v)
    return sorted((tuple(one(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_query(spark, duck, name):
    assert plain(q.QUERIES[name](spark, SF).toPandas()) == plain(duck.execute(q.ORACLES[name]).df())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(q.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
