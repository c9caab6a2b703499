"""Every registered query of the library against its SQL."""

import pytest

from weftgraph.plans import registry

_SQL = registry.oracle_sql()
_LEFT = sorted(set(registry.queries()) - set(_SQL))


@pytest.mark.parametrize("name", sorted(_SQL))
def test_query_equals_sql(name, same_rows):
    same_rows(registry.queries()[name], _SQL[name])


@pytest.mark.parametrize("name", _LEFT)
def test_query_without_sql_gives_rows(name, spark):
    assert registry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0


def test_entry_is_the_flagship(spark):
    import __spark_entry__

    assert [tuple(r) for r in __spark_entry__.entry(spark).collect()] == [(125968,)]
