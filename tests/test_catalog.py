"""Every registered query runs; those with a statement give its rows."""

import pytest
from frames import same_rows

from wealthspark import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, data, name):
    got = catalog.QUERIES[name](spark, data).toPandas()
    if name in catalog.ORACLE_SQL:
        same_rows(got, duck.sql(catalog.ORACLE_SQL[name]).df())
    else:
        assert len(got)
