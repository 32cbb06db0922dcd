"""Queries against their SQL on nulls, NaN, infinities, zeros and fractions in every column they read."""

import duckdb
import pytest

import __spark_entry__ as entry
from tests import oracle

COLUMNS = "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus".split()
ODD = ("'nan'", "'inf'", "'-inf'", "0.0", "'-0.0'", "2.5", "3.5", "-1.5", "48.0", "49.0")


@pytest.fixture(scope="module")
def odd_lines(sf, tmp_path_factory):
    """Forty order lines, again with null in one column at a time, and again with an odd number there."""
    place = tmp_path_factory.mktemp("odd")
    some = f"SELECT * FROM '{sf}/lineitem.parquet' WHERE l_orderkey < 40"
    changed = [f"SELECT * REPLACE (NULL AS {c}) FROM ({some})" for c in COLUMNS]
    for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"):
        changed += [f"SELECT * REPLACE ({v}::DOUBLE AS {c}) FROM ({some})" for v in ODD if c != "l_quantity" or v not in ODD[:3]]
    changed += [f"SELECT * REPLACE (0.0::DOUBLE AS l_quantity, {v}::DOUBLE AS l_extendedprice) FROM ({some})" for v in ODD]
    duckdb.sql(f"COPY ({' UNION ALL '.join([some, *changed])}) TO '{place}/lineitem.parquet' (FORMAT parquet)")
    return str(place)


def test_vector_columns(spark, odd_lines, tmp_path):
    entry.queries()["vector_columns"](spark, odd_lines).write.parquet(f"{tmp_path}/out")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{odd_lines}/lineitem.parquet'")
    got = con.execute(f"SELECT * FROM '{tmp_path}/out/*.parquet'").df()
    wanted = con.execute(entry.oracle_sql()["vector_columns"]).df()
    assert len(wanted) > 1000 and oracle.compare(got, wanted) is None
