"""Every query of the catalog against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from palisade import queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return c


def rows(frame):
    def cell(v):
        return "NULL" if v is None or str(v) in ("nan", "NaT", "<NA>") else f"{v:.6g}" if isinstance(v, float) else str(v)

    cols = sorted(frame.columns)
    return cols, sorted(tuple(map(cell, r)) for r in frame[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, DATA).toPandas()
    if name not in queries.SQL:
        assert len(got) > 0
        return
    assert rows(got) == rows(duck.sql(queries.SQL[name]).df())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
