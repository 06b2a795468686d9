"""Every registered core query against its SQL on the smallest tables, and the driver's contract."""

import duckdb
import pytest

import __spark_entry__
from tessera.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v != v:
        return "~"
    return f"{v:.6f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    rows = [tuple(map(plain, r)) for r in got.collect()]
    assert len(set(got.columns)) == len(got.columns)
    if name in registry.ORACLE_SQL:
        want = duck.sql(registry.ORACLE_SQL[name])
        assert sorted(want.columns) == sorted(got.columns)
        assert sorted(rows) == sorted(tuple(map(plain, r)) for r in want.select(*[f'"{c}"' for c in got.columns]).fetchall())


def test_entry_and_contract(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
