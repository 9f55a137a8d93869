"""Every registered query with SQL against DuckDB, on the smallest tables."""

import pytest

from tidewright.plans import month_queries as m
from tidewright.plans import queries as q

SF = "/root/testdata/sf0.001"


QUERIES, SQL = q.queries() | m.queries(), q.oracle_sql() | m.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, same_rows, name):
    same_rows(QUERIES[name](spark, SF).toPandas(), duck.execute(SQL[name]).df())


def test_entry_imports_without_the_optional_parts():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries())
