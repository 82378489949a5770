"""Every query with SQL gives the rows of its SQL."""

import pytest

from oracle import spark_rows, sql_rows
from paperloom.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, data, name):
    assert spark_rows(catalog.queries()[name](spark, data)) == sql_rows(catalog.oracle_sql()[name], data)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["source", "target", "label", "weight"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
