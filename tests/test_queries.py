"""Every core query against its SQL on the same tables."""

import glob
import os

import duckdb
import pytest

from deltaweave import catalog


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(rows):
    return sorted(repr([(k, r[k]) for k in sorted(r)]) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, data, duck, name):
    got = catalog.QUERIES[name](spark, data).toArrow().to_pylist()
    want = duck.sql(catalog.SQL[name]).to_arrow_table().to_pylist()
    assert plain(got) == plain(want)


def test_entry(spark, data):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 30
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
