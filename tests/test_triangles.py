import os
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import edges, triangles
from weftgraph.storage import dealt_by_part


def complete(n, first=0):
    return list(combinations(range(first, first + n), 2))


CASES = {
    "K6": (complete(6), 20),
    "K6 less an edge": (complete(6)[1:], 16),
    "cycle": ([(i, (i + 1) % 7) for i in range(7)], 0),
    "star": ([(0, i) for i in range(1, 9)], 0),
    "path": ([(i, i + 1) for i in range(6)], 0),
    "bipartite": ([(a, b) for a in range(4) for b in range(10, 15)], 0),
    "wheel": ([(0, i) for i in range(1, 7)] + [(i, i % 6 + 1) for i in range(1, 7)], 6),
    "two K5": (complete(5) + complete(5, 100), 20),
}


def frame(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long")


@pytest.mark.parametrize("plan", triangles.PLANS)
@pytest.mark.parametrize("name", CASES)
def test_closed_forms(spark, name, plan):
    rows, expected = CASES[name]
    assert triangles.triangle_count(edges.clean(frame(spark, rows)), plan).first()[0] == expected


@pytest.mark.parametrize("plan", triangles.PLANS)
def test_dirt_and_new_names_change_nothing(spark, plan):
    rows = complete(7)
    dirty = [(b, a) for a, b in rows] + rows * 2 + [(i, i) for i in range(9)] + [(None, 3), (2, None)]
    named = [(None if a is None else (a * 37) % 101, None if b is None else (b * 37) % 101) for a, b in dirty]
    for r in (dirty, named):
        assert triangles.triangle_count(edges.clean(frame(spark, r)), plan).first()[0] == 35


def test_empty_graph(spark):
    empty = edges.clean(frame(spark, []))
    for plan in triangles.PLANS:
        assert triangles.triangle_count(empty, plan).first()[0] == 0
    assert edges.max_ids(frame(spark, [])).first()["n_dense"] == 0


def test_orientation_has_no_large_start(spark):
    g = edges.clean(frame(spark, [(0, i) for i in range(1, 500)] + complete(12, 1)))
    assert edges.out_degrees(edges.oriented(g)).agg(F.max("out_degree")).first()[0] <= 33


def test_supports_add_up(spark):
    g = edges.clean(frame(spark, CASES["wheel"][0]))
    assert triangles.edge_support(g).agg(F.sum("support")).first()[0] == 18
    assert triangles.triangles_per_vertex(g).where("id = 0").first()["triangles"] == 6


def test_no_cartesian_product_and_no_python(spark, capsys):
    g = edges.clean(frame(spark, complete(5)))
    for plan in triangles.PLANS:
        triangles.triangle_count(g, plan).explain()
    text = capsys.readouterr().out
    assert "CartesianProduct" not in text and "Python" not in text and "InArrow" not in text


def shuffled(spark, run):
    """(result, bytes that its stages write for shuffles)."""
    def total():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
        return {(stages.apply(i).stageId(), stages.apply(i).attemptId()): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}

    before = total()
    out = run()
    return out, sum(v for k, v in total().items() if k not in before)


@pytest.mark.parametrize("split", [0, 64, 256, 2048])
def test_split_points_change_no_count(spark, split):
    rows = [(a, b) for a in range(90) for b in range(a) if (a * b + a) % 5 < 2] + [(a, a + 1) for a in range(100, 140)]
    g = edges.clean(frame(spark, rows))
    assert triangles.triangle_count(g, "split", split=split).first()[0] == triangles.triangle_count(g, "wedge").first()[0] > 1000


def test_split_moves_less_than_lists(spark):
    from weftgraph.plans import fixtures as fx
    from weftgraph.storage import stored

    g = stored(fx.parts(spark, "/root/testdata/sf0.01"), "graph")
    (a, whole), (b, split) = (shuffled(spark, lambda p=p: triangles.triangle_count(g, p).first()[0]) for p in ("adjacency", "split"))
    assert a == b and 0 < split < whole
    with pytest.raises(ValueError):
        triangles.triangle_count(g, "split", split=100)


@pytest.mark.parametrize("block", [1, 2, 7, 1024])
def test_blocks_change_no_intersection(spark, block):
    rows = [(a, b) for a in range(70) for b in range(a + 1, 70) if (a * b + b) % 4 < 2] + [(0, b) for b in range(70, 150)]
    directed = frame(spark, rows).select(F.col("src").alias("s"), F.col("dst").alias("t")).distinct()
    got = {}
    for r in triangles.block_intersections(directed, block).collect():
        got.setdefault((r["s"], r["t"]), []).extend(r["common"])
    to = {}
    for a, b in set(rows):
        to.setdefault(a, set()).add(b)
    want = {(a, b): sorted(to[a] & to.get(b, set())) for a, b in set(rows) if to[a] & to.get(b, set())}
    assert {k: sorted(v) for k, v in got.items() if v} == want


def test_a_hub_is_many_small_rows(spark):
    n, k, block = 50_000, 40, 512
    star = spark.range(1, n + 1).select(F.lit(0).cast("long").alias("s"), F.col("id").alias("t"))
    clique = spark.createDataFrame([(a, b) for a in range(1, k + 1) for b in range(a + 1, k + 1)], "s long, t long")
    second = spark.range(k + 1, n + 1, 2).select(F.lit(1).cast("long").alias("s"), F.col("id").alias("t"))  # 1 is a hub as well
    directed = star.unionByName(clique).unionByName(second)
    found = triangles.block_intersections(directed, block).agg(F.sum(F.size("common"))).first()[0]
    assert found == k * (k - 1) // 2 + k * (k - 1) * (k - 2) // 6 + len(range(k + 1, n + 1, 2))
    pairs = triangles.block_pairs(triangles.out_blocks(directed, block))
    assert pairs.agg(F.max(F.greatest(F.size("targets"), F.size("ends")))).first()[0] <= 2 * block
    many = spark.range(1, n + 1).select(F.lit(0).cast("long").alias("s"), F.col("id").alias("t")).unionByName(spark.range(1, n + 1).select(F.col("id").alias("s"), (F.col("id") + n).alias("t")))
    work = triangles.block_pairs(triangles.out_blocks(many, block)).where("s = 0").repartition(16, "s", "b").groupBy(F.spark_partition_id()).agg(F.sum(F.size("targets") * F.size("ends")).alias("w")).select("w").collect()
    sizes = sorted(r["w"] for r in work)
    assert len(sizes) > 8 and sizes[-1] <= 10 * sizes[len(sizes) // 2]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_edges_with_their_parts_are_not_broadcast(spark):
    """Consecutive ids pack well as Parquet, so Spark takes what the edges carry for small."""
    from weftgraph.operators.edges import oriented

    n = 300
    whole = spark.range(n).select(F.col("id").alias("u")).crossJoin(spark.range(n).select(F.col("id").alias("v"))).where("u < v")
    directed = oriented(whole)
    plan = _plan(triangles.intersections(directed))
    assert "BuildRight" in plan and "BuildLeft" not in plan
    assert triangles.triangle_count(whole).first()[0] == n * (n - 1) * (n - 2) // 6
    known, triangles.LISTED = triangles.LISTED, 10
    try:
        assert "BroadcastHashJoin" not in _plan(triangles.intersections(directed))
        assert triangles.triangle_count(whole).first()[0] == n * (n - 1) * (n - 2) // 6
    finally:
        triangles.LISTED = known


@pytest.mark.parametrize("plan", ["wedge", "hash", "bitmap"])
def test_wedges_travel_as_arrays(spark, plan):
    """No exchange lies above the explode of what edges carry, with one task or many."""
    from weftgraph.operators.edges import oriented
    from weftgraph.storage import dealt_by_part

    rows = [(a, b) for a in range(-20, 40) for b in range(a + 1, 40) if (a * 7 + b * 13) % 3]
    g = spark.createDataFrame(rows, "u long, v long")
    known = set(rows)
    want = sum((b, c) in known and (a, c) in known for a, b in rows for c in range(b + 1, 40))
    directed = oriented(g)
    for per in (50, 1_000_000):
        with dealt_by_part(spark):
            df = triangles.count_bits(directed, per) if plan == "bitmap" else triangles.triangles(directed, "merge" if plan == "wedge" else "shuffle_hash", per).agg(F.count(F.lit(1)))
            text = _plan(df)
            found = df.first()[0]
        assert found == want
        assert text.count("Exchange hashpartitioning") == 3
    assert triangles.triangle_count(g, plan).first()[0] == want


@pytest.mark.parametrize("plan", ["wedge", "hash", "bitmap"])
def test_ids_beyond_32_bits(spark, plan):
    g = spark.createDataFrame([(a + (a % 2) * (1 << 40), b + (b % 2) * (1 << 40)) for a, b in complete(8)], "src long, dst long")
    assert triangles.triangle_count(edges.clean(g), plan).first()[0] == 56


@pytest.mark.parametrize("held", [1_000_000, 100])
def test_lists_meet_in_a_grid_of_tasks(spark, monkeypatch, held):
    """Many lists: counts, counts of vertices and of edges are the same, whatever the shape of the grid."""
    rows = [(a + (a % 3 == 0) * (1 << 40), b + (b % 3 == 0) * (1 << 40)) for a in range(-20, 40) for b in range(a + 1, 40) if (a * a + b * b) % 7 < 4]
    g = edges.clean(frame(spark, rows))
    found = lambda: (triangles.triangle_count(g).first()[0], sorted(map(tuple, triangles.triangles_per_vertex(g).collect())), sorted(map(tuple, triangles.edge_support(g).collect())))
    want = found()
    assert want[0] == triangles.triangle_count(g, "wedge").first()[0] > 1000
    for name, value in (("LISTED", 0), ("HELD", held), ("SUMMED", 10_000)):
        monkeypatch.setattr(triangles, name, value)
    assert found() == want


def test_a_list_goes_to_a_task_once(spark, monkeypatch):
    """Cliques of neighbouring ids: what is shuffled is a small part of the wedges, and gone when the count is there."""
    rows = spark.range(20).select((F.col("id") * 1000).alias("k")).crossJoin(spark.range(150).select(F.col("id").alias("a"))).crossJoin(spark.range(150).select(F.col("id").alias("b")))
    g = rows.where("a < b").select((F.col("k") + F.col("a")).alias("u"), (F.col("k") + F.col("b")).alias("v"))
    monkeypatch.setattr(triangles, "LISTED", 1)
    lists = triangles._lists(g)
    with dealt_by_part(spark):
        one, sent = shuffled(spark, lambda: triangles.shared(lists).agg(F.sum(F.size("common"))).first()[0])
    directed = edges.oriented(g)
    two, whole = shuffled(spark, lambda: triangles.intersections(directed).agg(F.sum(F.size("common"))).first()[0])
    assert one == two == 20 * 150 * 149 * 148 // 6 and 0 < 3 * sent < whole
    files = lambda: {f for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("|").split("|") if "shuffle_" in f}
    before = files()
    assert triangles.triangle_count(g).first()[0] == one
    assert sum(os.path.getsize(f) for f in files() - before) < sent / 10
