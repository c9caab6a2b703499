"""How PageRank and its report move edges."""

import re

import pytest

from weftgraph.operators import graph


def test_report_groups_where_its_rows_lie(spark):
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0), (0, 2, 1.0), (2, 0, 1.0), (1, 2, 1.0)], "src long, dst long, w double")
    ranks = spark.createDataFrame([(0, 0.5), (1, 0.2), (2, 0.3)], "id long, pr double")
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        df = graph.pagerank_report(edges, ranks)
        assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 4
        rows = sorted((r["id"], r["degree"], round(r["max_diff"], 6), r["arg"]) for r in df.collect())
        assert rows == [(0, 2, 0.3, 1), (1, 2, 0.3, 0), (2, 1, 0.2, 0)]
    finally:
        spark.conf.set(name, before)


def test_links_of_pagerank_go_in_as_many_tasks_as_their_number_asks_for(spark, monkeypatch):
    rows = [(i, (i * 7 + k) % 50, 1.0 + k) for i in range(50) for k in range(1, 5)]
    edges = spark.createDataFrame(rows, "src long, dst long, w double")
    want = dict(map(tuple, graph.pagerank(edges, max_iter=4, fixed=True)[0].collect()))
    plans, keep = [], graph.stored

    def seen(df, name, like=None):
        if name == "pagerank":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df, name, like)

    monkeypatch.setattr(graph, "stored", seen)
    monkeypatch.setattr(graph, "PER_TASK", 20)
    found = dict(map(tuple, graph.pagerank(edges, max_iter=4, fixed=True)[0].collect()))
    assert found == pytest.approx(want)
    assert all(re.search(r"hashpartitioning\(src#\d+L, 10\), REPARTITION_BY_NUM", p) for p in plans) and plans
