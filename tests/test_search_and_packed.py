"""Direction-changing search and packed graphs against plain Python."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftgraph.operators import graph, packed
from weftgraph.operators.search import direction_search, from_words, to_words
from weftgraph.storage import stored


def plain_search(pairs, starts):
    """(levels, report) by hand."""
    links = {(a, b) for a, b in pairs if a is not None and b is not None}
    level = dict.fromkeys((s for s in starts if s is not None), 0)
    front, at, kept, report = set(level), 0, -1, []
    while front:
        out = sum(a in front for a, _ in links)
        rest = sum(b not in level for _, b in links)
        way = "none" if not out or not rest else "bottom-up" if out > rest else "top-down"
        kept = at if report and report[-1][4] == "bottom-up" else kept
        fewer = {(a, b) for a, b in links if level.get(b, math.inf) > kept}
        read = 0 if way == "none" else rest if way == "bottom-up" else sum(a in front for a, _ in fewer)
        report.append((at, len(front), out, rest, way, read))
        if way == "none":
            break
        front = {b for a, b in links if a in front and b not in level}
        at += 1
        level |= dict.fromkeys(front, at)
    return level, report


def check_search(spark, pairs, starts):
    edges = spark.createDataFrame(pairs, "src long, dst long")
    levels, report = direction_search(edges, spark.createDataFrame([(s,) for s in starts], "id long"))
    level, lines = plain_search(pairs, starts)
    assert sorted(map(tuple, levels.collect())) == sorted(level.items())
    assert sorted(map(tuple, report.collect())) == lines
    return lines


def test_search_against_plain_python(spark):
    rng = random.Random(3)
    ids = [rng.randint(-200, 200) for _ in range(90)] + [-(2**63), 2**63 - 1, -1, 0, 63, 64]
    sparse = [(rng.choice(ids), rng.choice(ids)) for _ in range(160)]
    check_search(spark, sparse + sparse[:9] + [(None, 1), (1, None), (5, 5)], [ids[0], ids[1], None, 7_000])
    dense = [(a, b) for a in range(60) for b in range(60) if a != b and rng.random() < 0.3]
    lines = check_search(spark, dense + [(59, 1000), (1000, 1001), (2000, 2001)], [0])
    assert "bottom-up" in {x[4] for x in lines}
    assert sum(x[5] for x in lines) < sum(x[2] for x in lines) / 2  # less than half of what top-down alone reads


def test_search_at_the_edges(spark):
    none = spark.createDataFrame([], "src long, dst long")
    assert [tuple(r) for r in graph.bfs_levels(none, 4).collect()] == [(4, 0)]
    levels, report = direction_search(none, spark.createDataFrame([], "id long"))
    assert levels.count() == report.count() == 0
    # ways change more than once, over more levels than are merged at a time
    chain = [(i, i + 1) for i in range(12)]
    bulge = [(12, 100 + i) for i in range(30)] + [(100 + i, 200) for i in range(30)] + [(100 + i, 100 + j) for i in range(30) for j in range(9) if i != j]
    lines = check_search(spark, chain + bulge + [(200 + i, 201 + i) for i in range(12)], [0])
    assert len(lines) > 20 and {x[4] for x in lines} == {"top-down", "bottom-up", "none"}


def test_words_are_sets(spark):
    ids = [-(2**63), -65, -64, -1, 0, 0, 63, 64, 2**63 - 1]
    words = to_words(spark.createDataFrame([(i,) for i in ids], "id long"))
    assert sorted(r[0] for r in from_words(words).collect()) == sorted(set(ids))


@settings(max_examples=60, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 1023), st.one_of(st.integers(-(2**63), 2**63 - 1), st.integers(0, 50))), min_size=1, max_size=60), st.sampled_from([-(2**53), -2, -1, 0, 7, 2**53 - 1]))
def test_packed_lists_round_trip(pairs, block):
    rows = sorted(((block << packed.SHIFT) + a, b) for a, b in pairs)
    src, dst = (np.array(c, np.int64) for c in zip(*rows))
    vertices, neighbours = packed.pack_lists(block, src, dst)
    heads, degree = packed.heads_of(block, vertices)
    assert np.repeat(heads, degree).tolist() == src.tolist()
    assert packed.ends_of(heads, degree, neighbours).tolist() == dst.tolist()


@pytest.mark.parametrize("part_edges", [7, packed.PART_EDGES])
def test_packed_graph_is_the_graph(spark, part_edges):
    rng = random.Random(5)
    ids = [rng.randint(-3000, 3000) for _ in range(200)] + [-(2**63), 2**63 - 1]
    pairs = [(rng.choice(ids), rng.choice(ids)) for _ in range(700)] + [(5, i) for i in range(400)]  # a hub
    edges = spark.createDataFrame([*pairs, *pairs[:20], (None, 1), (1, None)], "src long, dst long")
    g = packed.pack_graph(edges, part_edges=part_edges)
    assert sorted(map(tuple, packed.unpack(g).collect())) == sorted(set(pairs))
    degree = {}
    for a, _ in set(pairs):
        degree[a] = degree.get(a, 0) + 1
    assert {r[0]: r[1] for r in packed.out_degrees(g).collect()} == degree
    again = packed.open_packed(spark, g.name)
    assert sorted(map(tuple, again.shape.collect())) == sorted(map(tuple, g.shape.collect()))
    mine = dict(map(tuple, packed.pagerank(g, rounds=4).collect()))
    other = dict(map(tuple, graph.pagerank(edges.dropna().distinct().withColumn("w", F.lit(1.0)), max_iter=4, fixed=True)[0].collect()))
    assert mine.keys() == other.keys() and all(math.isclose(mine[k], other[k], rel_tol=1e-9) for k in other)


def test_an_empty_graph_is_packed(spark):
    g = packed.pack_graph(spark.createDataFrame([], "src long, dst long"))
    assert packed.unpack(g).count() == packed.out_degrees(g).count() == packed.pagerank(g).count() == 0


def folder_size(spark, df):
    fs = spark._jvm.org.apache.hadoop.fs.Path(df.inputFiles()[0].rsplit("/", 1)[0])
    return fs.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(fs).getLength()


def test_packed_edges_are_small_and_stay(spark):
    n = 40_000
    edges = spark.range(n * 12).select((F.col("id") % n).alias("src"), F.pmod(F.xxhash64("id"), F.lit(n)).alias("dst")).distinct()
    g = packed.pack_graph(edges)
    assert 2 * folder_size(spark, g.table) <= folder_size(spark, stored(edges, "pairs"))
    plan = packed.edge_sums(g, spark.range(n).select("id", F.lit(1.0).alias("x")))._jdf.queryExecution().executedPlan().toString()
    lines = plan.split("== Initial Plan ==")[-1].splitlines()
    scan = next(i for i, x in enumerate(lines) if g.name in x)
    join = max(i for i, x in enumerate(lines[:scan]) if "SortMergeJoin" in x or "ShuffledHashJoin" in x)
    assert not any("Exchange" in x for x in lines[join:scan])  # from the table to the join no edge is moved


@pytest.mark.parametrize("kept", [False, True])
def test_links_are_made_in_as_many_tasks_as_edges_ask_for(spark, monkeypatch, kept):
    rows = [(i, (i * 7 + k) % 500, float(k)) for i in range(500) for k in (3, 2)] + [(5, None, 1.0), (-200, 70, 1.0)]
    df = spark.createDataFrame(rows, "src long, dst long, w double")
    df = stored(df, "edges") if kept else df
    few = {tuple(r) for r in graph._links(df, F.min("w").alias("w")).collect()}
    monkeypatch.setattr(graph, "PER_SET", 25)
    links = graph._links(df, F.min("w").alias("w"))
    assert len(links.inputFiles()) > 30  # 1,002 edges in 41 tasks
    assert {tuple(r) for r in links.collect()} == few and len(few) == 1002
    found = {r["id"] for r in graph._vertices(links).collect()}
    assert found == {x for a, b, _ in rows for x in (a, b)} and graph._vertices(links).count() == len(found)


def test_components_are_ordered_in_as_many_tasks_as_edges_ask_for(spark, monkeypatch):
    many = [(4 * i + a, 4 * i + b) for i in range(1, 2001) for a, b in ((0, 2), (2, 1), (1, 3))]
    large = [(20_000 + i, 20_001 + i) for i in range(300)]
    rows = [x for e in many + large for x in (e, e[::-1])] + [(3, 3), (5, None), (None, 2**60 + 1)]
    df = spark.createDataFrame(rows, "src long, dst long")
    monkeypatch.setattr(graph, "PER_ORDER", 300)
    monkeypatch.setattr(graph, "BATCH", 7)
    order = graph.best_first_order(df, 20_299, 5)
    assert order.rdd.getNumPartitions() == 43  # 12,601 edges
    assert "FlatMapGroups" not in order._jdf.queryExecution().executedPlan().toString()  # a group for each component has its price
    found = {r["id"]: (r["component"], r["place"]) for r in order.collect()}
    want = {4 * i + a: (4 * i, k) for i in range(1, 2001) for k, a in enumerate((0, 2, 1, 3))} | {3: (3, 0)}
    assert {v: p for v, p in found.items() if v < 20_000} == want
    chain = [found[20_000 + i] for i in range(301)]
    assert {c for c, _ in chain} == {20_000} and sorted(p for _, p in chain) == list(range(301)) and chain[299][1] == 0 and len(found) == 8302


def test_flows_of_a_block_are_added_up_before_they_leave():
    """A block's rows give one batch with each end once, near ends or far ones."""
    import numpy as np
    import pyarrow as pa

    for step in (1, 1 << 40):
        rows, want = [], {}
        for part in range(3):
            src = np.repeat(np.arange(4), 5)
            dst = np.tile(np.arange(part, part + 5) * step, 4)
            rows.append((0, *packed.pack_lists(0, src, dst), [0, 1, 2, 3], [1.0, 2.0, 0.0, 4.0]))
            for a, b in zip(src, dst):
                want[int(b)] = want.get(int(b), 0.0) + [1.0, 2.0, 0.0, 4.0][a]
        names = ["block", "vertices", "neighbours", "ids", "shares"]
        out = list(packed._flows(iter([pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[:2])], names=names), pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[2:])], names=names)])))
        assert len(out) == 1 and dict(zip(*(c.to_pylist() for c in out[0].columns))) == want
