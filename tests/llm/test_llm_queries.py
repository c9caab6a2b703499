"""Queries of the subpackage against their SQL, and the pipeline."""

import pytest

from weftgraph.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(name, same_rows):
    same_rows(QUERIES[name], ORACLE_SQL[name])


def test_there_is_one_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
