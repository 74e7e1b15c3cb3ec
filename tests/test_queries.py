"""Every registered query with SQL gives DuckDB's rows on the smallest tables."""

import os

import duckdb
import pytest

from brindle.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in catalogue.TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6) + 0.0
    return value


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in catalogue.ORACLES:
        assert got
        return
    rel = duck.sql(catalogue.ORACLES[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    want = sorted((tuple(plain(r[k]) for k in at) for r in rel.fetchall()), key=repr)
    assert got == want


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalogue.QUERIES) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name, table", [("order_nulls", "documents"), ("order_collate_unicode", "documents"), ("order_collate_binary", "documents"), ("order_unprojected", "orders")])
def test_order_covers_the_whole_table(spark, name, table):
    """Every row has its place, also those beyond the rows that the capped statement returns."""
    larger = "/root/testdata/sf0.1" if name == "order_nulls" else "/root/testdata/sf0.01"
    rows = catalogue.QUERIES[f"{name}_place"](spark, larger).collect()
    assert sorted(r.place for r in rows) == list(range(1, spark.read.parquet(f"{larger}/{table}.parquet").count() + 1))
    con = duckdb.connect()
    for t in catalogue.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{larger}/{t}.parquet'")
    rel = con.sql(catalogue.ORACLES[f"{name}_place"])
    assert sorted(rel.fetchall(), key=str) == sorted((tuple(r[c] for c in rel.columns) for r in rows), key=str)
    if name == "order_nulls":
        assert {r.quality for r in rows} == {0, 1, None}
