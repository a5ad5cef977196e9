"""Every registered query at the smallest scale, against its SQL where it has one."""

import pytest

import __spark_entry__ as entry
from workload.check import duck_connection, rows_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return duck_connection(SF)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["type", "severity", "description", "evidence", "threat_lists"] and df.count() == 10


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got = rows_of(df.columns, df.collect())
    assert got
    sql = entry.oracle_sql().get(name)
    if sql is not None:
        result = duck.execute(sql)
        names = [d[0] for d in result.description]
        assert sorted(names) == sorted(df.columns)
        assert got == rows_of(names, result.fetchall())
