"""Graphs of the driver's tables: how their rows are dealt."""

import pytest

from weftgraph.plans import fixtures as fx
from weftgraph.plans import registry

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["raw", "parts", "suppliers", "strong", "weighted", "priced", "in_line_order"])
def test_pairs_go_in_as_many_tasks_as_lines_ask_for(spark, monkeypatch, name):
    few = getattr(fx, name)(spark, SF)
    want = sorted(map(tuple, few.collect()))
    lines = fx.table(spark, SF, "lineitem").count()
    monkeypatch.setattr(fx, "PER_TASK", lines // 30)
    many = getattr(fx, name)(spark, SF)
    assert sorted(map(tuple, many.collect())) == want
    n = -(-lines // (lines // 30))
    assert "hashpartitioning(l_orderkey" in _plan(many) and f", {n}), REPARTITION_BY_NUM" in _plan(many)
    assert "Broadcast" not in _plan(few)


@pytest.mark.parametrize("name", ["bipartite", "cust_part"])
def test_orders_and_lines_are_not_broadcast(spark, name):
    assert "Broadcast" not in _plan(getattr(fx, name)(spark, SF))


def test_order_by_degree_makes_its_graph_once(spark, monkeypatch):
    made, pairs = [], fx._pairs
    monkeypatch.setattr(fx, "_pairs", lambda *x, **y: made.append(x) or pairs(*x, **y))
    df = registry.queries()["bfs_order_by_degree_strong"](spark, SF)
    assert len(made) == 1 and "lineitem" not in _plan(df)
