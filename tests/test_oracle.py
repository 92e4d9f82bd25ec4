"""Every registered query with an SQL twin gives its rows; the others give some."""

import pytest

from tests.compare import differ
from trendloom.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, name):
    f, sql = registry.queries()[name], registry.oracle_sql().get(name)
    if sql:
        assert differ(spark, SF, f, sql) == ""
    else:
        assert f(spark, SF).count() > 0
