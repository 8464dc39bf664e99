"""The driver's contract."""

import __spark_entry__ as entry


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    found = entry.entry(spark)
    assert found.columns == ["category", "token", "n", "first_key", "last_key", "key_sum"] and found.count() > 0
