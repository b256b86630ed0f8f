"""Every registered query of the core against its SQL in DuckDB."""

from __future__ import annotations

import pytest

from opsframe.plans import registry
from tests.compare import spark_rows, sql_rows

SF = "/root/testdata/sf0.01"
SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, name):
    columns, rows = spark_rows(registry.queries()[name](spark, SF))
    assert rows, "a query without rows shows nothing"
    if name in SQL:
        want_columns, want = sql_rows(SQL[name], SF)
        assert columns == want_columns
        assert rows == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
