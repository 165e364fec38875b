"""Every registered graph query against its SQL."""

import pytest
from conftest import SMALL, same_rows

from kinfolk import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    same_rows(catalog.QUERIES[name](spark, SMALL).toPandas(), duck.execute(catalog.ORACLE_SQL[name]).df())


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
