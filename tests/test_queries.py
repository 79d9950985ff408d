"""Every registered query runs; those with SQL return what DuckDB returns."""

import pytest
from conftest import SF, rows_of

from kairoscope import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    found = queries.QUERIES[name](spark, SF).toPandas()
    if name in queries.ORACLE:
        wanted = duck.execute(queries.ORACLE[name]).df()
        assert sorted(found.columns) == sorted(wanted.columns)
        assert rows_of(found) == rows_of(wanted)
    else:
        assert len(found)


def test_flagship(spark):
    assert queries.flagship(spark, SF).count() == 3
