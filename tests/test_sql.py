"""Every registered query against its SQL in DuckDB."""

import pytest

import __spark_entry__ as entry
from checks import compare

SQL = entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, db, sql_sf, name):
    df = entry.queries()[name](spark, sql_sf)
    cursor = db.execute(SQL[name])
    want = ([d[0] for d in cursor.description], cursor.fetchall())
    assert compare((df.columns, [tuple(r) for r in df.collect()]), want) == "ok"


def test_sql_belongs_to_a_query():
    assert set(SQL) <= set(entry.queries())


def test_entry(spark):
    found = entry.entry(spark)
    assert found.count() == 11 and "detected_type" in found.columns
