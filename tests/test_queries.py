"""Every registered query runs on the smallest tables, and equals its SQL where it has one."""

import duckdb
import pytest

import __spark_entry__ as entry
from compare import TABLES, canonical

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def db(sf):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return db


def test_contract(spark):
    assert set(SQL) <= set(entry.queries())
    assert entry.entry(spark).columns == ["registrant_id", "attribute_code", "valid_from", "valid_to"]


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, sf, db, name):
    df = entry.queries()[name](spark, sf)
    rows = [tuple(r) for r in df.collect()]
    if name in SQL:
        result = db.execute(SQL[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == sorted(df.columns)
        assert canonical(rows, df.columns) == canonical(result.fetchall(), names)
