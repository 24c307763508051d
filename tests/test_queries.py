import pytest
from oracle import differences

from octarine.plans import registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_equals_sql(spark, sf, name):
    assert differences(registry.QUERIES[name](spark, sf), registry.SQL[name], sf) == (0, 0)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_gives_rows(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
