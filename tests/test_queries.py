"""Every registered query of the engine's own operators runs; those with SQL match it."""

import pytest

from tarnlight import reachable, registry
from tests.conftest import duck_rows, rows_of


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf, name):
    reachable(spark)
    df = registry.queries()[name](spark, sf)
    rows = rows_of(df)
    if name in registry.oracle_sql():
        assert rows == duck_rows(registry.oracle_sql()[name], sf, df.columns)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["rank", "rel", "chunk_index", "score", "snippet"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
