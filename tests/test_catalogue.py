"""Every registered query with SQL against DuckDB on the smallest tables; the others run; and the entry."""

import pytest

import __spark_entry__ as driver
from rungwise.plans import catalogue

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_matches_sql(spark, duck, same, name):
    got = catalogue.QUERIES[name](spark, SMALL).toPandas()
    if name in catalogue.ORACLE_SQL:
        same(got, duck(catalogue.ORACLE_SQL[name], SMALL))
    else:
        assert len(got)


def test_entry(spark):
    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())
