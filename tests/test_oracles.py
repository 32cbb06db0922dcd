"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests import oracle

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf, name):
    got = QUERIES[name](spark, sf).toPandas()
    if name in SQL:
        message = oracle.compare(got, duck.execute(SQL[name]).df())
        assert message is None, message
    else:
        assert len(got)


def test_flagship(spark):
    assert entry.entry(spark).columns == ["threat_class", "severity", "alerts"]
