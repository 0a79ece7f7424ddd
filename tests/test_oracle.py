"""Every query that has SQL gives what DuckDB gives."""

import pytest
from helpers import SF, same_rows

from cuewright.plans import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name in registry.ORACLE_SQL:
        same_rows(got, duck.execute(registry.ORACLE_SQL[name]).df())
