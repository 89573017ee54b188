"""Every query against its SQL on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

from docloom.plans import catalog, catalog_cases, catalog_extend, catalog_more, catalog_sources, registry  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(frame: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return "null"
        if isinstance(v, float):
            return repr(round(v, 6)) if v != int(v) else str(int(v))
        return str(v.isoformat())[:19].removesuffix("T00:00:00") if hasattr(v, "isoformat") else str(v)

    columns = sorted(frame.columns)
    return sorted(tuple(cell(v) for v in row) for row in frame[columns].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return connection


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, duck, name):
    found = registry.QUERIES[name](spark, sf).toPandas()
    if name in registry.ORACLE_SQL:
        expected = duck.execute(registry.ORACLE_SQL[name]).df()
        assert sorted(found.columns) == sorted(expected.columns)
        assert plain(found) == plain(expected)


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
