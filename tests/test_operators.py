import bisect
import heapq
import math
import random
from itertools import combinations

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftgraph.functions import bitmaps, blas, scalars
from weftgraph.functions.containers import MaxQueue, MultiMap
from weftgraph.operators import components, edges, graph, matrix, metrics, mining, ordering, similarity
from weftgraph.streaming.incremental import GraphState, distinct_stream


def got(df):
    return sorted(map(tuple, df.collect()))


def entries(spark, rows):
    return spark.createDataFrame(rows, "row long, col long, val double")


def test_components_against_union_find(spark):
    random.seed(3)
    rows = [(random.randrange(300), random.randrange(300)) for _ in range(130)] + [(i, i + 1) for i in range(1000, 1200)] + [(5000, 5000)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in rows:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    df = spark.createDataFrame(rows, "src long, dst long")
    assert dict(got(components.connected_components(df))) == {x: find(x) for x in list(root)}
    assert components.connected_components(df.limit(0)).count() == 0


def test_shortest_paths_against_dijkstra(spark):
    random.seed(5)
    rows = [(random.randrange(40), random.randrange(40), float(random.randrange(1, 9))) for _ in range(120)] + [(90, 91, 1.0)]
    dist, heap, nbrs = {}, [(0.0, 0)], {}
    for a, b, w in rows:
        nbrs.setdefault(a, []).append((b, w))
    while heap:
        d, v = heapq.heappop(heap)
        if v not in dist:
            dist[v] = d
            for b, w in nbrs.get(v, ()):
                heapq.heappush(heap, (d + w, b))
    vertices = {x for a, b, _ in rows for x in (a, b)}
    df = spark.createDataFrame(rows, "src long, dst long, w double")
    assert dict(got(graph.shortest_paths(df, 0))) == {v: dist.get(v, -1.0) for v in vertices}
    with pytest.raises(ValueError):
        graph.shortest_paths(df.withColumn("w", -F.col("w")), 0)


def plain_rounds(rows, source):
    """Distances by rounds over the vertices that moved, and the edges that they relax."""
    nbrs, dist, moved, relaxed = {}, {source: 0}, {source}, 0
    for (a, b), w in rows.items():
        nbrs.setdefault(a, []).append((b, w))
    while moved:
        new = {}
        for a in moved:
            for b, w in nbrs.get(a, ()):
                relaxed += 1
                new[b] = min(new.get(b, math.inf), dist[a] + w)
        moved = {b for b, d in new.items() if d < dist.get(b, math.inf)}
        dist.update({b: new[b] for b in moved})
    return dist, relaxed


def test_delta_stepping_relaxes_a_third(spark):
    random.seed(6)
    rows = {}
    for _ in range(12_000):
        a, b = random.sample(range(400), 2)
        rows.setdefault((a, b), random.randint(1, 10_000))
    rows |= {(i, i + 1): 1 for i in range(15)}  # a long light way
    want, plain = plain_rounds(rows, 0)
    df = spark.createDataFrame([(a, b, w) for (a, b), w in rows.items()] + [(900, 901, 5)], "src long, dst long, w long")
    found, relaxed = graph.delta_stepping(df, 0)
    assert dict(got(found)) == {**want, 900: -1, 901: -1}
    assert len(rows) <= relaxed <= plain / 3


@pytest.mark.parametrize("delta", [None, 0.25, 3.0, 1e9])
def test_delta_stepping_against_rounds(spark, delta):
    random.seed(8)
    rows = {(random.randrange(25), random.randrange(25)): random.choice([0.0, 0.5, 1.0, 7.25]) for _ in range(70)}
    want, _ = plain_rounds(rows, 0)
    df = spark.createDataFrame([(a, b, w) for (a, b), w in rows.items() for w in (w, w + 1)], "src long, dst long, w double")
    ids = {x for pair in rows for x in pair}
    assert dict(got(graph.delta_stepping(df, 0, delta)[0])) == {v: want.get(v, -1) for v in ids}


def test_delta_stepping_at_the_edges(spark):
    df = spark.createDataFrame([(1, 2, 0), (2, 3, 0)], "src long, dst long, w int")
    assert got(graph.delta_stepping(df, 1)[0]) == [(1, 0), (2, 0), (3, 0)]
    assert got(graph.delta_stepping(df, 7)[0]) == [(1, -1), (2, -1), (3, -1)]  # no such source
    assert graph.delta_stepping(df.limit(0), 1)[0].count() == 0
    for bad in (df.withColumn("w", F.lit(-1)), df.withColumn("w", F.lit(None).cast("int"))):
        with pytest.raises(ValueError):
            graph.delta_stepping(bad, 1)
    with pytest.raises(ValueError):
        graph.delta_stepping(df, 1, 0.0)


def test_pagerank_is_a_distribution_and_converges(spark):
    rows = [(0, 1, 1.0), (1, 2, 2.0), (2, 0, 1.0), (2, 3, 1.0)]  # 3 is a sink
    df = spark.createDataFrame(rows, "src long, dst long, w double")
    pr, rounds = graph.pagerank(df, eps=1e-10, max_iter=200)
    values = dict(got(pr))
    assert rounds <= 200 and math.isclose(sum(values.values()), 1.0, abs_tol=1e-8)
    assert graph.pagerank(df, eps=0.0, max_iter=3)[1] == 4
    r = graph.random_restarts(pr.select("id"), 2, 9)
    assert len(r) == 2 and all(math.isclose(x.agg(F.sum("r")).first()[0], 1.0) for x in r)


def plain_best_first(nbrs, source, kind, matrix):
    """Scores from scratch at every step; the best, then the smallest id, is placed next."""
    places = {}
    while len(places) < len(nbrs):
        scores = {}
        for u in nbrs.keys() - places.keys():
            at = [places[x] for x in nbrs[u] if x in places]
            if at:
                last, n, total = max(at), len(at), sum(at)
                three = float(total) if matrix else math.sqrt(total)
                scores[u] = [1000.0 * (last + 1) + n, n, three, n * last - total, -1000.0 * (min(at) + 1) + 1, float((last + 1) * n)][kind - 1]
        free = nbrs.keys() - places.keys()
        v = min(scores, key=lambda u: (-scores[u], u)) if scores else source if not places else min(free)
        places[v] = len(places)
    return sorted(places, key=places.get)


@pytest.mark.parametrize("kind, as_matrix", [*((k, False) for k in range(1, 7)), (3, True)])
def test_best_first_against_plain_python(spark, kind, as_matrix):
    random.seed(kind)
    rows = sorted({tuple(sorted(random.sample(range(30), 2))) for _ in range(70)}) + [(50, 51), (51, 52), (51, 53)]
    both = edges.both_directions(spark.createDataFrame(rows, "u long, v long"))
    nbrs = {}
    for a, b in rows:
        nbrs.setdefault(a, set()).add(b)
        nbrs.setdefault(b, set()).add(a)
    comp = dict(got(components.connected_components(both)))
    want = {}
    for c in set(comp.values()):
        own = {v: n for v, n in nbrs.items() if comp[v] == c}
        for place, v in enumerate(plain_best_first(own, 7 if 7 in own else min(own), kind, as_matrix)):
            want[v] = (c, place)
    assert {r["id"]: (r["component"], r["place"]) for r in graph.best_first_order(both, 7, kind, as_matrix).collect()} == want


def places(df):
    return [r["id"] for r in df.orderBy("place").collect()]


def test_bfs_orders(spark):
    both = edges.both_directions(spark.createDataFrame([(0, 1), (1, 2), (2, 3), (10, 11)], "u long, v long"))
    assert places(graph.bfs_order(both, 2)) == [2, 1, 3, 0, 10, 11]
    assert places(graph.bfs_order(both, 11)) == [11, 10, 0, 1, 2, 3]
    assert places(graph.bfs_order(both)) == places(graph.bfs_order(both, 999)) == [0, 1, 2, 3, 10, 11]  # no such source
    assert graph.bfs_order(both.limit(0), 1).count() == 0
    deg = edges.degrees(spark.createDataFrame([(0, 1), (1, 2), (2, 3), (10, 11)], "u long, v long"))
    assert places(graph.bfs_order_by_degree(both, deg, 2, 3)) == [1, 2, 3, 0, 10, 11]
    assert places(graph.bfs_order_by_degree(both, deg, 2, 1)) == [1, 2, 0, 3, 10, 11]  # the source is of high degree
    assert places(graph.bfs_order_by_degree(both, deg, 1)) == [1, 2, 0, 3, 10, 11]  # none is left for the rest


def test_long_paths_settle(spark):
    n = 60
    rows = spark.range(n - 1).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    both = edges.both_directions(rows)
    assert got(graph.bfs_levels(both, 0)) == [(i, i) for i in range(n)]
    assert got(graph.shortest_paths(both.withColumn("w", F.lit(2)), 0)) == [(i, 2 * i) for i in range(n)]
    with pytest.raises(RuntimeError):
        graph.shortest_paths(both.withColumn("w", F.lit(2)), 0, max_rounds=9)


def test_pagerank_chains_rounds(spark):
    ring = [(i, (i + 1) % 5, 1.0 + i) for i in range(5)] + [(i, (i + 2) % 5, 1.0) for i in range(5)]
    df = spark.createDataFrame(ring, "src long, dst long, w double")
    one, many = (dict(got(graph.pagerank(df, max_iter=7, fixed=True, chain=c)[0])) for c in (1, 5))
    assert one.keys() == many.keys() and all(math.isclose(one[k], many[k], rel_tol=1e-12) for k in one)


def test_matrix_edge_cases(spark):
    m = entries(spark, [(0, 0, 1.0), (0, 1, -1.0), (1, 0, 0.0), (2, 2, 4.0)])
    unit = dict(((r, c), v) for r, c, v in got(matrix.normalise(m, "row", 1)))
    assert unit[0, 0] == 0.0 and unit[1, 0] == 0.0 and unit[2, 2] == 1.0
    assert got(matrix.scale(m, "sqrt"))[2] == (1, 0, 0.0)
    assert got(matrix.make_symmetric(m, "sum"))[-1] == (2, 2, 8.0)
    assert got(matrix.compact_columns(m))[-1] == (2, 2, 4.0)
    s = matrix.shuffle(m, "both", 3)
    assert sorted(r["val"] for r in s.collect()) == [-1.0, 0.0, 1.0, 4.0]
    assert got(matrix.shuffle(m, "row", 3)) == got(matrix.shuffle(m, "row", 3))
    sym = matrix.shuffle(entries(spark, [(i, i, float(i)) for i in range(9)]), "row", 1, symmetric=True)
    assert all(r["row"] == r["col"] for r in sym.collect())
    with pytest.raises(ValueError):
        matrix.prune(m, "diag", 0, 1)
    with pytest.raises(ValueError):
        matrix.scale(m, "nothing")


def test_low_filter_keeps_the_crossing_entry(spark):
    m = entries(spark, [(0, i, float(v)) for i, v in enumerate((5, 3, 2))])
    assert got(matrix.low_filter(m, "row", 1, 0.5)) == [(0, 0, 5.0), (0, 1, 3.0)]


def test_layered_graph(spark):
    g = spark.createDataFrame([(0, 1), (0, 2)], "u long, v long")
    assert len(got(matrix.layered_graph(g, 1, 10))) == 4
    rows = got(matrix.layered_graph(g, 2, 10))
    assert (0, 10) in rows and (10, 0) in rows and (0, 11) in rows and (0, 12) not in rows


def test_similarity_of_a_row_with_itself(spark):
    m = entries(spark, [(0, 0, 1.0), (0, 1, 2.0), (1, 1, 2.0), (2, 5, 1.0)])
    for kind in ("cos", "jac", "min", "amin"):
        sims = {(a, b): s for a, b, s in got(similarity.neighbours(m, m, kind, None, 0.0))}
        assert sims[0, 0] == 1.0 and (0, 2) not in sims
    with pytest.raises(ValueError):
        similarity.neighbours(m, m, "none")


def test_itemsets_against_brute_force(spark):
    random.seed(1)
    tx = {t: set(random.sample(range(8), random.randrange(1, 6))) for t in range(40)}
    df = spark.createDataFrame([(t, i) for t, s in tx.items() for i in list(s) * 2], "tid long, item long")
    expected = {}
    for n in (2, 3, 4):
        for c in combinations(range(8), n):
            tids = [t for t, s in tx.items() if set(c) <= s]
            if len(tids) >= 4:
                expected[c] = tids
    found = {tuple(r["items"]): r["tids"] for r in mining.frequent_itemsets(df, 4, min_len=2, max_len=4, with_tids=True).collect()}
    assert found == expected
    assert mining.frequent_itemsets(df, 1000).count() == 0


@pytest.mark.parametrize("most", [1, 60, 10**6])
def test_projected_itemsets_are_the_levels(spark, most):
    random.seed(2)
    rows = [(f"t{t:02}", f"i{i}") for t in range(60) for i in random.sample(range(9), random.randrange(1, 7)) * 2]
    rows += [("t00", f"i{i}") for i in range(40)] + [(None, "i1"), ("t01", None)]
    df = spark.createDataFrame(rows, "tid string, item string")
    plain = lambda r: {tuple(x["items"]): (x["support"], x["tids"]) for x in r.collect()}
    for limits in ({}, {"min_len": 2, "max_len": 3}, {"max_freq": 30}, {"max_len": 1}, {"max_len": 2}):
        found = mining.projected_itemsets(df, 4, with_tids=True, most=most, **limits)
        assert found.count() == len(plain(found)) and plain(found) == plain(mining.frequent_itemsets(df, 4, with_tids=True, **limits))
    assert mining.projected_itemsets(df.limit(0), 1).count() == mining.projected_itemsets(df, 1000).count() == 0
    with pytest.raises(ValueError):
        mining.projected_itemsets(df, 0)


def test_jobs_of_projected_itemsets_do_not_grow_with_the_length(spark):
    def jobs(longest):
        tx = spark.range(5 * longest).select((F.col("id") % 5).alias("tid"), F.floor(F.col("id") / 5).alias("item"))
        spark.sparkContext.setJobGroup(f"len-{longest}", "")
        try:
            found = mining.projected_itemsets(tx, 5)
            assert found.count() == 2**longest - 1
            return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"len-{longest}"))
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

    assert jobs(9) == jobs(4)


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([(1, 9, 1), (2, 8, 0), (3, 7, 1), (4, 6, 0)], "key long, score long, label int")
    assert metrics.accuracy(df).first()[0] == 75.0
    assert metrics.roc_n(df).first()[0] == 0.75
    assert metrics.median_rfp(df).first()[0] == 0.0
    none = df.withColumn("label", F.lit(0))
    assert metrics.roc_n(none).first()[0] == 0.0


def test_ranks_and_sums_over_many_partitions(spark):
    df = spark.range(2000).select((F.col("id") * 7919 % 2000).alias("x")).repartition(9)
    assert got(ordering.with_rank(df, "x")) == [(i, i) for i in range(2000)]
    assert got(ordering.running_sum(df, F.col("x"), "x", inclusive=False))[-1] == (1999, 1999 * 1998 // 2)
    assert ordering.is_sorted(df.withColumn("y", F.col("x")), "x", "y").first()[0] == 0
    assert ordering.is_sorted(df.withColumn("y", -F.col("x")), "x", "y").first()[0] == 1999


def test_bitmaps(spark):
    df = spark.createDataFrame([(0, i) for i in (0, 5, 63, 64, 99)], "k long, m long")
    b = bitmaps.from_members(df, "k", "m", 100)
    row = b.select(
        bitmaps.count("bits").alias("n"), bitmaps.count(bitmaps.not_("bits", 100)).alias("z"), bitmaps.get("bits", F.lit(64)).alias("g"), bitmaps.get("bits", F.lit(65)).alias("h"),
        (bitmaps.from_bytes(bitmaps.to_bytes("bits")) == F.col("bits")).alias("same"), F.size(bitmaps.append("bits", "bits")).alias("len"), bitmaps.count(bitmaps.or_all("bits", "bits", "bits")).alias("o"),
    ).first()
    assert tuple(row) == (5, 95, True, False, True, 4, 5)


def test_regex_first_match_only(spark):
    df = spark.createDataFrame([("aXbXc",)], "s string")
    row = df.select(scalars.regex_replace("s", "(X)", r"[$1\$]").alias("a"), scalars.regex_replace("s", "x", "-", "gi").alias("b"), scalars.regex_matches("s", "X").alias("n")).first()
    assert tuple(row) == ("a[X$]bXc", "a-b-c", 1)


@given(st.lists(st.tuples(st.sampled_from(["insert", "update", "delete", "top"]), st.integers(0, 5), st.integers(-9, 9)), max_size=60))
def test_queue_is_a_max_queue(steps):
    q, model, n = MaxQueue(), {}, 0
    for what, v, k in steps:
        n += 1
        if what == "insert" and v not in model:
            q.insert(v, k)
            model[v] = (k, -n)
        elif what == "update" and v in model:
            q.update(v, k)
            model[v] = (k, -n)
        elif what == "delete" and v in model:
            q.delete(v)
            del model[v]
        elif what == "top":
            want = max(model, key=model.get) if model else -1
            assert q.top() == want
            model.pop(want, None)
        assert len(q) == len(model)


def brute_neighbourhoods(a, b):
    """The means over rows and columns of two {(row, col): val}, all in plain Python."""

    def lists(m):
        rows = {}
        for (r, c), v in m.items():
            rows.setdefault(r, {})[c] = v
        unit = {r: {c: v / math.sqrt(sum(x * x for x in vs.values())) for c, v in vs.items()} for r, vs in rows.items()}
        return {q: {r: s for r in unit if (s := sum(v * unit[r].get(c, 0) for c, v in unit[q].items())) > 0} for q in unit}

    def mean(a, b):
        x, y, cos = lists(a), lists(b), []
        for q in x.keys() & y.keys():
            norm = math.sqrt(sum(v * v for v in x[q].values()) * sum(v * v for v in y[q].values()))
            cos.append(sum(v * y[q].get(r, 0) for r, v in x[q].items()) / norm if norm else 0)
        return sum(cos) / len(cos)

    flip = lambda m: {(c, r): v for (r, c), v in m.items()}
    return {"rows": mean(a, b), "cols": mean(flip(a), flip(b))}


def test_neighbourhoods_against_brute_force(spark):
    random.seed(4)
    a = {(random.randrange(30), random.randrange(12)): float(random.randint(1, 20)) for _ in range(150)}
    b = {k: v for k, v in a.items() if v > 10} | {(99, 0): 3.0}  # 99 has entries in b only
    make = lambda m: spark.createDataFrame([(*k, v) for k, v in m.items()], "row long, col long, val double")
    found = dict(map(tuple, similarity.compare_neighbourhoods(make(a), make(b)).collect()))
    assert found == pytest.approx(brute_neighbourhoods(a, b), abs=2e-6)
    alike = dict(map(tuple, similarity.compare_neighbourhoods(make(a), make(a), k=3).collect()))
    assert alike == {"rows": 1.0, "cols": 1.0}


def test_lone_rows_have_a_neighbourhood_of_themselves(spark):
    make = lambda *rows: spark.createDataFrame(rows, "row long, col long, val double")
    a, b = make((1, 1, 2.0), (2, 2, 0.0)), make((1, 1, 5.0), (2, 2, 1.0))
    # row 1 meets itself alone in both; row 2 has no similarity in a, so counts as 0
    assert dict(map(tuple, similarity.compare_neighbourhoods(a, b).collect())) == {"rows": 0.5, "cols": 0.5}


def test_neighbourhoods_are_of_whole_matrices(spark, duck):
    from weftgraph.plans import registry

    found = dict(map(tuple, registry.queries()["neighbourhood_similarity"](spark, "/root/testdata/sf0.001").collect()))
    a = {(r, c): v for r, c, v in duck.sql("SELECT o_custkey, l_partkey, sum(l_quantity) FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2").fetchall()}
    assert found == pytest.approx(brute_neighbourhoods(a, {k: v for k, v in a.items() if v > 10}), abs=2e-6)


def test_multimap():
    m = MultiMap()
    m.insert(1, 10)
    m.insert(1, 11)
    assert m.search(1) == 10 and m.values(1) == [10, 11] and m.search_and_delete(1) == 10 and m.search(1) == 11 and m.search(2) == -1


def test_streamed_edges_keep_the_total(spark, tmp_path):
    random.seed(8)
    rows = [(random.randrange(14), random.randrange(14)) for _ in range(90)]
    state = GraphState(spark, str(tmp_path / "state"))
    for i in range(3):
        batch = spark.createDataFrame(rows[i * 30 : i * 30 + 30], "src long, dst long")
        state.update(batch, i)
        state.update(batch, i)  # a batch that runs twice
    g = edges.clean(spark.createDataFrame(rows, "src long, dst long"))
    from weftgraph.operators.triangles import triangle_count

    assert state.triangles().first()[0] == triangle_count(g).first()[0]
    assert got(state.degrees()) == got(edges.degrees(g))


def test_streaming_query(spark, tmp_path):
    spark.createDataFrame([(1, 2), (2, 1), (3, 3), (2, 3)], "src long, dst long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("src long, dst long").parquet(str(tmp_path / "in"))
    q = distinct_stream(stream).writeStream.format("memory").queryName("edges_out").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert got(spark.table("edges_out")) == [(1, 2), (2, 3)]


@pytest.mark.parametrize("kind, least", [("cos", 0.3), ("jac", 0.2), ("min", 0.2), ("amin", 0.3)])
def test_frequent_columns_change_no_neighbour(spark, kind, least):
    random.seed(11)
    rows = [(r, c, float(random.randrange(1, 9))) for r in range(60) for c in range(40) if random.random() < (0.9 if c < 3 else 0.12)]
    m = entries(spark, rows)
    plain, split = (got(similarity.neighbours(m.where("row % 3 = 0"), m, kind, 7, least, often=n)) for n in (10**6, 25))
    assert [r[:2] for r in plain] == [r[:2] for r in split] and len(plain) > 60
    assert [r[2] for r in plain] == pytest.approx([r[2] for r in split], rel=1e-12)


@pytest.mark.parametrize("kind, least", [("cos", 0.6), ("jac", 0.5), ("dotp", 260.0), ("min", 0.4), ("amin", 0.5)])
def test_candidates_lose_nothing_and_are_few(spark, kind, least):
    """The bounded search against all pairs that share a column, in plain Python; also for values below 0 and empty norms."""
    random.seed(13)
    sign = (-1, 1) if kind in ("dotp", "cos", "jac") else (1,)
    rows = {(r, c): float(random.choice(sign) * random.randrange(1, 9)) for r in range(90) for c in range(50) if random.random() < (0.9 if c < 4 else 0.12)}
    for r in range(90, 110):  # near copies of other rows
        rows |= {(r, c): v + (c % 7 == 0) for (q, c), v in list(rows.items()) if q == r - 90}
    rows[200, 0] = 0.0
    by = {}
    for (r, c), v in rows.items():
        by.setdefault(r, {})[c] = v

    def sim(a, b):
        dot = sum(v * b.get(c, 0) for c, v in a.items())
        low = sum(min(v, b[c]) for c, v in a.items() if c in b)
        sa, sb, qa, qb = sum(a.values()), sum(b.values()), sum(v * v for v in a.values()), sum(v * v for v in b.values())
        top, below = {"dotp": (dot, 1), "cos": (dot, math.sqrt(qa * qb)), "jac": (dot, qa + qb - dot), "min": (low, sa + sb - low), "amin": (low, sa)}[kind]
        return top / below if below else 0.0

    m = entries(spark, [(*k, v) for k, v in rows.items()])
    want = {(a, b): s for a in by for b in by if by[a].keys() & by[b].keys() and (s := sim(by[a], by[b])) >= least}
    found = {(a, b): s for a, b, s in got(similarity.neighbours(m, m, kind, None, least, often=1))}
    assert found == pytest.approx(want, rel=1e-9) and len(want) > 50
    met = similarity.candidates(m, m, kind, least)[0].count()
    meeting = sum(bool(by[a].keys() & by[b].keys()) for a in by for b in by)
    assert len(want) <= met and (kind == "amin" or met < 0.8 * meeting)


def test_thresholds_are_exact_on_every_path(spark):
    """Similarities within 1e-9 of the threshold: no rounding lets one in, and no path loses one."""
    rows, least = [(0, 0, 1.0)], 0.25
    shifts = [-1e-7, -1e-9, 1e-9, 1e-7, 0.0]
    for i, e in enumerate(shifts, 1):
        x = least * (1 + e)
        rows += [(i, 0, x), (i, i, math.sqrt(1 - x * x))]
    m = entries(spark, rows)
    for often in (1, 3, 10**6):
        found = {r for q, r, _ in got(similarity.neighbours(m.where("row = 0"), m, "cos", None, least, often=often))}
        assert found >= {0, 3, 4} and not found & {1, 2}, often


def test_pairs_without_entries_are_rows(spark):
    m = entries(spark, [(0, 0, 1.0), (1, 1, 2.0)])
    pairs = spark.createDataFrame([(0, 0), (0, 1), (0, 5), (5, 6), (5, 6)], "i1 long, i2 long")
    for compat in (False, True):
        assert got(similarity.pair_similarity(m, m, pairs, "cos", compat)) == [(0, 0, 1.0), (0, 1, 0.0), (0, 5, 0.0), (5, 6, 0.0)]


def test_metrics_are_not_rounded(spark):
    df = spark.createDataFrame([(1e-8,), (3e-8,)], "x double")
    assert tuple(metrics.mean_std(df, "x").first()) == pytest.approx((2e-8, 1e-8), rel=1e-12)


@pytest.mark.parametrize("form", ["columns", "rows"])
def test_neighbourhoods_by_either_form(spark, form, capsys):
    random.seed(14)
    a = {(random.randrange(25), random.randrange(14)): float(random.randint(1, 20)) for _ in range(140)}
    b = {k: v for k, v in a.items() if v > 8} | {(99, 3): 3.0}
    make = lambda m: spark.createDataFrame([(*k, v) for k, v in m.items()], "row long, col long, val double")
    found = dict(map(tuple, similarity.compare_neighbourhoods(make(a), make(b), form=form).collect()))
    assert found == pytest.approx(brute_neighbourhoods(a, b), abs=1e-9)


@pytest.mark.parametrize("form", ["columns", "rows"])
@pytest.mark.parametrize("small", [False, True])
def test_neighbourhoods_make_no_row_for_a_pair(spark, form, small, monkeypatch):
    random.seed(16)
    a = {(random.randrange(60), random.randrange(20)): float(random.randint(1, 20)) for _ in range(900)}
    b = {k: v for k, v in a.items() if v > 8} | {(99, 3): 3.0}
    for name, value in (("BLOCK", 100), ("LISTED", 200), ("AT_ONCE", 50)) if small else ():  # many blocks, lists in pieces
        monkeypatch.setattr(similarity, name, value)
    make = lambda m: spark.createDataFrame([(*k, v) for k, v in m.items()], "row long, col long, val double")
    seen, sums = [], similarity._sums
    monkeypatch.setattr(similarity, "_sums", lambda *args: seen.append(sums(*args)) or seen[-1])
    found = dict(map(tuple, similarity.compare_neighbourhoods(make(a), make(b), form=form).collect()))
    assert found == pytest.approx(brute_neighbourhoods(a, b), abs=1e-9)
    if not small:  # one block gives one row for each row and column
        assert [x.count() for x in seen] == [61 + 20]


def test_searches_take_a_step_a_bit(spark):
    random.seed(15)
    big = sorted(random.sample(range(10**6), 100_000))
    asked = [big[0] - 1, big[0], big[777], big[777] + 1, big[-1], big[-1] + 1]
    df = spark.createDataFrame([(big, x) for x in asked] + [([], 3), (None, 3), ([5], 5), ([5], 4), ([1, 1, 2, 2, 2, 3], 2)], "a array<long>, x long")
    rows = df.select(blas.lower_bound("a", F.col("x")).alias("l"), blas.upper_bound("a", F.col("x")).alias("u"), blas.place_of("a", F.col("x")).alias("p"), "a", "x").collect()
    for r in rows:
        if r["a"] is None:
            assert r["l"] is r["u"] is r["p"] is None
            continue
        lo, hi = bisect.bisect_left(r["a"], r["x"]), bisect.bisect_right(r["a"], r["x"])
        assert (r["l"], r["u"], r["p"]) == (lo, hi, lo if hi > lo else -1)


def test_hot_rows_are_filtered_alike(spark):
    random.seed(12)
    rows = [(0 if random.random() < 0.7 else random.randrange(1, 9), c, float(random.randrange(1, 50))) for c in range(900)]
    m = entries(spark, rows)
    for norm in (1, 2):
        want = []
        for r in {x[0] for x in rows}:
            own = sorted((x for x in rows if x[0] == r), key=lambda x: (-x[2], x[1]))
            total, before = sum(x[2] ** norm for x in own), 0.0
            for x in own:
                want += [x] if before <= total * 0.4 else []
                before += x[2] ** norm
        assert got(matrix.low_filter(m, "row", norm, 0.4)) == sorted(want)
    top = [x for r in {x[0] for x in rows} for i, x in enumerate(sorted((x for x in rows if x[0] == r), key=lambda x: (-x[2], x[1]))) if i < 3 or x[2] >= 47]
    assert got(matrix.top_k_plus(m, "row", 3, 47.0)) == sorted(top)


def test_what_is_stored_is_released(spark):
    from weftgraph.storage import released, stored

    with released(spark) as keep:
        gone, stays = stored(spark.range(5), "gone"), keep(stored(spark.range(5).where("id > 9"), "stays"))
    assert stays.count() == 0 and spark.read.parquet(stays._weft_path).columns == ["id"]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(gone._weft_path)


def test_hub_lists_in_parts(spark):
    star = spark.range(1, 500).select(F.lit(0).cast("long").alias("u"), F.col("id").alias("v"))
    rows = edges.adjacency(star, chunk=50).collect()
    hub = [r["nbrs"] for r in rows if r["id"] == 0]
    assert len(hub) == 10 and max(map(len, hub)) < 90 and sorted(x for n in hub for x in n) == list(range(1, 500))
    assert all(n == sorted(n) for n in hub) and len(rows) == 10 + 499


def test_links_of_neighbouring_ids_are_summed_where_they_lie(spark, monkeypatch):
    """Copies of a graph with shifted ids: a round sends about the vertices, not the links, and its files go."""
    from test_triangles import shuffled

    from weftgraph.storage import stored

    copies = spark.range(40).select((F.col("id") * 5000).alias("k"))
    pair = spark.range(100).select(F.col("id").alias("a")).crossJoin(spark.range(100).select(F.col("id").alias("b"))).where("a <> b")
    links = stored(copies.crossJoin(pair).select((F.col("k") + F.col("a")).alias("src"), (F.col("k") + F.col("b")).alias("dst"), F.lit(1.0).alias("w")), "links")
    monkeypatch.setattr(graph, "PER_TASK", 50_000)
    (few, one), (many, two) = (shuffled(spark, lambda r=r: graph.pagerank(links, max_iter=r, fixed=True)[0].agg(F.min("pr"), F.max("pr"), F.count("id")).first()) for r in (2, 12))
    assert few[2] == many[2] == 4000 and abs(many[0] - 1 / 4000) < 1e-12 and abs(many[1] - 1 / 4000) < 1e-12
    assert (two - one) / 10 < 4000 * 60  # of 396,000 links
