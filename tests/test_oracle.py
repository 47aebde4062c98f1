"""Every registered query with SQL agrees with DuckDB on the smallest tables."""

import pytest

from netloom.plans import ENTRIES
from oracle import compare, database

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return database(FOLDER)


@pytest.mark.parametrize("name", [n for n, e in ENTRIES.items() if e.sql])
def test_query_matches_sql(spark, db, name):
    entry = ENTRIES[name]
    ok, note = compare(spark, db, FOLDER, entry.run, entry.sql)
    assert ok, note
