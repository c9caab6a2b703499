"""Iterative graph algorithms as loops of stored DataFrames: no vertex list reaches the driver."""

from __future__ import annotations

import heapq
import math
import uuid
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.components import connected_components
from weftgraph.operators.edges import block_bits
from weftgraph.operators.ordering import with_rank
from weftgraph.operators.search import direction_search, from_words, to_words
from weftgraph.storage import dealt_by_part, discard, new_path, shuffles_dropped, stored

#: Links of a task that reads them in every round, at most about.
PER_TASK = 4_000_000

#: Edges of a task that makes edges distinct, at most about.
PER_SET = 1_000_000

#: Edges of a task that orders whole components, about; a component of more is still one task's work.
PER_ORDER = 250_000

#: Rows of a batch that a task of Python gives out, about.
BATCH = 10_000


def pagerank(edges: DataFrame, follow: float = 0.85, eps: float = 1e-9, max_iter: int = 100, restart: DataFrame | None = None, fixed: bool = False, chain: int = 1) -> tuple[DataFrame, int]:
    """((id, pr), rounds) of weighted edges (src, dst, w).

    pr' = follow (sinks r + P' pr) + (1 - follow) r with P normalised by weight and r the ``restart``
    distribution (id, r), uniform if left out; it also is the first pr.  Ends when no value moves by eps,
    or after ``max_iter`` rounds (``fixed``: just then), when rounds is one more.

    Only vertices move: edges are a table bucketed by blocks of neighbouring sources, so what a task's edges lead to
    is mostly summed there; where 1,024 neighbouring ids have too many edges for that, they are persisted, dealt by source.  Each step is stored, and its shuffle files go before the next begins; with a fixed number
    of rounds and no sinks only every ``chain`` of them are, whose shuffles are on disk together.
    """
    spark = edges.sparkSession
    edges = stored(edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), "w"), "edges")
    tens = edges.groupBy(F.shiftright("src", 10).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    k = block_bits(tens.select(F.shiftleft("b", 10).alias("id"), "n"), PER_TASK // 4)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-edges.count() // PER_TASK))
    name, by = f"weft_links_{uuid.uuid4().hex}", ["_b", "src"] if k else ["src"]
    links = edges.where("src is not null").withColumn("_b", F.shiftright("src", k)).repartition(n, by[0]).sortWithinPartitions(*by, "dst")
    if k:
        with shuffles_dropped(spark):
            links.write.format("parquet").option("compression", "zstd").option("path", new_path(spark, "links")).bucketBy(n, "_b").saveAsTable(name)
        discard(edges)
        links = spark.table(name)
    else:
        links = links.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        with dealt_by_part(spark):
            out = stored(links.groupBy("src").agg(F.sum("w").alias("o")), "out")
            ends = links.select(F.col("dst").alias("id")).distinct().select("id", F.lit(None).cast("double").alias("o"))
            vertices = stored(out.select(F.col("src").alias("id"), F.col("o").cast("double").alias("o")).unionByName(ends).groupBy("id").agg(F.max("o").alias("o")), "vertices")
            if restart is None:
                restart = vertices.crossJoin(F.broadcast(vertices.agg(F.count(F.lit(1)).alias("n")))).select("id", (1 / F.col("n")).alias("r"))
            base = stored(vertices.join(restart, "id", "left").select("id", F.coalesce("r", F.lit(0.0)).alias("r"), F.when(F.col("o") > 0, F.col("o")).alias("o")), "restart")
            closed = base.where("o is null").isEmpty()
            now, kept = base.withColumn("pr", F.col("r")), None
            for i in range(1, max_iter + 1):
                share = now.where("o is not null").select(F.shiftright("id", k).alias("_b"), F.col("id").alias("src"), (F.col("pr") / F.col("o")).alias("x")).select(*by, "x")
                flow = links.join(share.hint("shuffle_hash"), by).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("w") * F.col("x")).alias("_in"))
                back = F.coalesce("_in", F.lit(0.0))
                nxt = base.join(flow, "id", "left")
                if not closed:
                    lost = now.where("o is null").agg(F.coalesce(F.sum("pr"), F.lit(0.0)).alias("_lost"))
                    nxt, back = nxt.crossJoin(F.broadcast(lost)), back + F.col("_lost") * F.col("r")  # one row on the other side
                nxt = nxt.select("id", "r", "o", (follow * back + (1 - follow) * F.col("r")).alias("pr"))
                if fixed and closed and i % chain and i < max_iter:
                    now = nxt
                    continue
                nxt = stored(nxt, "pagerank")
                moved = None if fixed else nxt.join(now.select("id", F.col("pr").alias("old")), "id").agg(F.max(F.abs(F.col("pr") - F.col("old")))).first()[0]
                if kept is not None:
                    discard(kept)
                now = kept = nxt
                if moved is not None and moved < eps:
                    return now.select("id", "pr"), i
            return now.select("id", "pr"), max_iter + (not fixed)
    finally:
        if k:
            discard(links)
            spark.sql(f"DROP TABLE {name}")
        else:
            links.unpersist()
            discard(edges)


def random_restarts(vertices: DataFrame, n: int, seed: int) -> list[DataFrame]:
    """n random restart distributions (id, r)."""
    out = []
    for k in range(n):
        drawn = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed + k}:"), F.col("id").cast("string"))), 1, 8), 16, 10).cast("long")
        raw = vertices.select("id", (drawn + 1.0).alias("x"))
        out.append(raw.crossJoin(F.broadcast(raw.agg(F.sum("x").alias("s")))).select("id", (F.col("x") / F.col("s")).alias("r")))
    return out


def pagerank_report(edges: DataFrame, ranks: DataFrame) -> DataFrame:
    """(id, pr, degree, max_diff, arg): largest difference of pr to a neighbour, and which one."""
    other = ranks.select(F.col("id").alias("dst"), F.col("pr").alias("_q"))
    # the join by src comes last, so its rows already lie as the grouping needs them
    rows = edges.select("src", "dst").join(other, "dst").join(ranks.select(F.col("id").alias("src"), "pr"), "src")
    diff = F.abs(F.col("pr") - F.col("_q"))
    best = F.max(F.struct(diff.alias("d"), (-F.col("dst")).alias("m")))
    return rows.groupBy(F.col("src").alias("id"), "pr").agg(F.count(F.lit(1)).alias("degree"), best.alias("b")).select("id", "pr", "degree", F.col("b.d").alias("max_diff"), (-F.col("b.m")).alias("arg"))


def bfs_levels(edges: DataFrame, source: int) -> DataFrame:
    """(id, level) of vertices that (src, dst) reach from ``source``, itself at 0 even without edges."""
    return search_report(edges, source)[0]


def search_report(edges: DataFrame, source: int) -> tuple[DataFrame, DataFrame]:
    """The rows of ``bfs_levels``, and for each level which way it went and what it read (``direction_search``)."""
    return direction_search(edges, edges.sparkSession.range(1).select(F.lit(source).cast("long").alias("id")))


def bfs_order(edges: DataFrame, source: int | None = None) -> DataFrame:
    """(id, component, level, place): breadth-first from ``source``, then the other components by their
    smallest id, each from that (G5); ties by id.  Without a source, or with one that no edge has, the
    order begins at the smallest id."""
    comp = stored(connected_components(edges), "comp")
    home = None if source is None else comp.where(F.col("id") == source).select("component").first()
    roots = comp.where("id = component").select("id")
    if home is not None:  # one id takes another's place
        roots = roots.select(F.when(F.col("id") == home["component"], F.lit(source).cast("long")).otherwise(F.col("id")).alias("id"))
    rows = direction_search(edges, roots)[0].join(comp, "id")
    far = F.lit(1) if home is None else (F.col("component") != home["component"]).cast("int")
    return with_rank(rows.select("id", "component", "level", far.alias("_far")), "_far", "component", "level", "id", name="place").drop("_far")


def bfs_order_by_degree(edges: DataFrame, deg: DataFrame, max_degree: int, source: int | None = None) -> DataFrame:
    """(id, place): vertices of at least ``max_degree`` by falling degree, then breadth-first over the rest
    (G6), from ``source`` if it is one of the rest, else from the smallest id of the rest."""
    high = deg.where(F.col("degree") >= max_degree)
    low = deg.where(F.col("degree") < max_degree).select("id")
    inside = edges.join(low.select(F.col("id").alias("src")), "src", "left_semi").join(low.select(F.col("id").alias("dst")), "dst", "left_semi")
    loops = low.select(F.col("id").alias("src"), F.col("id").alias("dst"))
    rest = bfs_order(inside.select("src", "dst").unionByName(loops), source).select("id", F.lit(1).alias("_g"), F.col("place").alias("_k"))
    first = high.select("id", F.lit(0).alias("_g"), (-F.col("degree")).cast("long").alias("_k"))
    return with_rank(first.unionByName(rest), "_g", "_k", "id", name="place").select("id", "place")


def _dealt(edges: DataFrame, *columns: str) -> DataFrame:
    """``columns`` of edges, stored and dealt by both ends into as many tasks as their number asks for: splits of
    a stored table and what adaptive execution puts together are sized by bytes, of which ends take few, and
    their sets of ends many."""
    edges = edges if hasattr(edges, "_weft_path") else stored(edges.select(*columns), "edges")
    n = max(edges.sparkSession.sparkContext.defaultParallelism, -(-edges.count() // PER_SET))
    return edges.repartition(n, "src", "dst")


def _links(edges: DataFrame, *values: Column) -> DataFrame:
    """A stored table of (src, dst, values): each pair of ends of edges (src, dst, w) once."""
    return stored(_dealt(edges, "src", "dst", "w").groupBy("src", "dst").agg(*values), "links")


def _vertices(links: DataFrame) -> DataFrame:
    """(id): the ends of links (src, dst), made distinct as words of 64 ids; a null end is one, too."""
    ends = links.select(F.explode(F.array(F.col("src").cast("long"), F.col("dst").cast("long"))).alias("id"))
    words = stored(to_words(ends), "words")
    none = words.where("word is null").select(F.col("word").alias("id"))
    return from_words(words.where("word is not null")).unionByName(none)


def shortest_paths(edges: DataFrame, source: int, max_rounds: int = 10_000) -> DataFrame:
    """(id, dist) of every vertex of edges (src, dst, w), -1 where unreachable (G8); w must not be negative.

    A round relaxes the edges of the vertices that moved in the last one and looks up only these ends;
    distances are merged every eight rounds.  Raises where ``max_rounds`` don't settle it.
    """
    links = _links(edges, F.min("w").alias("w"))
    if not links.where("w < 0").isEmpty():
        raise ValueError("weights must not be negative")
    zero = F.lit(0).cast(links.schema["w"].dataType)
    dist = stored(edges.sparkSession.range(1).select(F.lit(source).cast("long").alias("id"), zero.alias("dist")), "sssp")
    fronts, front = [], dist

    def best(ids: DataFrame | None = None) -> DataFrame:
        rows = dist
        for f in fronts:
            rows = rows.unionByName(f)
        rows = rows if ids is None else rows.join(ids, "id", "left_semi")
        return rows.groupBy("id").agg(F.min("dist").alias("dist"))

    for _ in range(max_rounds):
        step = stored(links.join(front.select(F.col("id").alias("src"), "dist"), "src").groupBy(F.col("dst").alias("id")).agg(F.min(F.col("dist") + F.col("w")).alias("_new")), "step")
        before = best(step.select("id"))
        front = stored(step.join(before, "id", "left").where("dist is null or _new < dist").select("id", F.col("_new").alias("dist")), "front")
        discard(step)
        if front.isEmpty():
            break
        fronts.append(front)
        if len(fronts) == 8:  # the last front is read once more as it is
            whole = stored(best(), "sssp")
            for old in [dist, *fronts[:-1]]:
                discard(old)
            dist, fronts = whole, []
    else:
        raise RuntimeError(f"shortest paths did not settle in {max_rounds} rounds")
    return _vertices(links).join(best(), "id", "left").select("id", F.coalesce("dist", F.lit(-1)).alias("dist"))


def delta_stepping(edges: DataFrame, source: int, delta: float | None = None) -> tuple[DataFrame, int]:
    """((id, dist), relaxed): the rows of ``shortest_paths`` and how many edges were relaxed for them.

    Vertices settle in bands of distance ``delta`` wide (left out: twice the largest weight by the mean
    out-degree; narrower bands relax fewer edges in more jobs).  Inside a band only edges lighter than ``delta`` are relaxed, until no vertex of it moves;
    then its vertices relax their other edges, once, with distances that are final.  So heavy edges never
    carry a distance that changes later, which is what makes plain rounds relax edges again and again.
    Weights must be neither negative nor missing.

    A phase reads the links of the vertices that moved and looks up only the ends it met; what improved is
    kept as small tables, merged every eight.
    """
    links = _links(edges, F.min("w").alias("w"), F.count_if(F.col("w").isNull()).alias("_gone"))
    seen = links.agg(F.min("w").alias("low"), F.max("w").alias("high"), F.count(F.lit(1)).alias("n"), F.sum("_gone").alias("gone")).first()
    if seen["gone"] or (seen["n"] and seen["low"] < 0):
        raise ValueError("weights must be neither negative nor missing")
    if delta is None:
        sources = to_words(links.select(F.col("src").cast("long").alias("id"))).agg(F.sum(F.bit_count("bits"))).first()[0]
        delta = 2.0 * seen["high"] * (sources or 0) / seen["n"] if seen["n"] else 1.0
        delta = delta or 1.0  # all weights are 0
    if not 0 < delta < math.inf:
        raise ValueError("delta is a positive number")
    kind = links.schema["w"].dataType
    links = links.drop("_gone")
    light, heavy = links.where(F.col("w") < delta), links.where(F.col("w") >= delta)
    first = stored(edges.sparkSession.range(1).select(F.lit(source).cast("long").alias("id"), F.lit(0).cast(kind).alias("dist")), "sssp")
    dist, news, waiting, relaxed = first, [], [first], 0

    def every(tables: list[DataFrame]) -> DataFrame:
        rows = tables[0]
        for t in tables[1:]:
            rows = rows.unionByName(t)
        return rows

    def relax(some: DataFrame, moved: DataFrame) -> DataFrame:
        """A stored table of the vertices that edges of ``moved`` bring nearer."""
        nonlocal dist, relaxed
        met = some.join(moved.withColumnRenamed("id", "src"), "src")
        step = stored(met.groupBy(F.col("dst").alias("id")).agg(F.min(F.col("dist") + F.col("w")).cast(kind).alias("_new"), F.count(F.lit(1)).alias("_edges")), "step")
        relaxed += step.agg(F.coalesce(F.sum("_edges"), F.lit(0))).first()[0]
        known = every([dist, *news]).join(step.select("id"), "id", "left_semi").groupBy("id").agg(F.min("dist").alias("dist"))
        nearer = stored(step.join(known, "id", "left").where("dist is null or _new < dist").select("id", F.col("_new").alias("dist")), "nearer")
        discard(step)
        news.append(nearer)
        if len(news) == 8:
            dist = stored(every([dist, *news]).groupBy("id").agg(F.min("dist").alias("dist")), "sssp")
            news.clear()
        return nearer

    while True:
        # what still waits at its best distance; a vertex that came nearer waits there instead
        queue = every(waiting).groupBy("id").agg(F.min("dist").alias("dist"))
        best = every([dist, *news]).join(queue.select("id"), "id", "left_semi").groupBy("id").agg(F.min("dist").alias("_best"))
        queue = stored(queue.join(best, "id").where("dist = _best").select("id", "dist"), "queue")
        low = queue.agg(F.min("dist")).first()[0]
        if low is None:
            break
        end = (math.floor(low / delta) + 1) * delta
        end = end if end > low else math.nextafter(float(low), math.inf)  # where a band is too narrow for the number
        inside, beyond = F.col("dist") < end, F.col("dist") >= end
        moved, band, waiting = queue.where(inside), [], [queue.where(beyond)]
        while not moved.isEmpty():
            band.append(moved)
            nearer = relax(light, moved)
            waiting.append(nearer.where(beyond))
            moved = nearer.where(inside)
        settled = stored(every(band).groupBy("id").agg(F.min("dist").alias("dist")), "band")
        waiting.append(relax(heavy, settled))
    last = every([dist, *news]).groupBy("id").agg(F.min("dist").alias("dist"))
    return _vertices(links).join(last, "id", "left").select("id", F.coalesce("dist", F.lit(-1)).alias("dist")), relaxed


def compactness(edges: DataFrame, perm: DataFrame) -> DataFrame:
    """(mean, near1, near2, near3): how far apart ends lie under a permutation (id, place)."""
    a = perm.select(F.col("id").alias("src"), F.col("place").alias("_a"))
    b = perm.select(F.col("id").alias("dst"), F.col("place").alias("_b"))
    d = F.abs(F.col("_a") - F.col("_b"))
    near = [F.count_if(d == i).alias(f"near{i}") for i in (1, 2, 3)]
    return edges.join(a, "src").join(b, "dst").agg(F.avg(d).alias("mean"), *near)


def centroid_reorder(edges: DataFrame, perm: DataFrame, pull: float = 0.5) -> DataFrame:
    """(id, place): vertices moved towards the mean place of their neighbours and ranked again."""
    b = perm.select(F.col("id").alias("dst"), F.col("place").alias("_b"))
    mean = edges.join(b, "dst").groupBy(F.col("src").alias("id")).agg(F.avg("_b").alias("_m"))
    moved = perm.join(mean, "id", "left").select("id", (F.col("place") + F.lit(pull) * (F.coalesce("_m", F.col("place")) - F.col("place"))).alias("_k"))
    return with_rank(moved, "_k", "id", name="place").select("id", "place")


def _best_first(nbrs: dict[int, list[int]], source: int, kind: int, matrix: bool = False) -> list[int]:
    """Vertices of one component, best first; the kinds are those of ``best_first_order``."""
    placed: dict[int, int] = {}
    inside: dict[int, int] = {v: 0 for v in nbrs}
    total: dict[int, int] = {v: 0 for v in nbrs}
    current = {source: 0.0}

    def score(u: int, i: int) -> float:
        if kind == 1:
            return 1000.0 * (i + 1) + inside[u]
        if kind == 2:
            return sum(1 for x in nbrs[u] if x in placed)
        if kind == 3:
            return float(total[u]) if matrix else math.sqrt(total[u])
        if kind == 4:
            return inside[u] * i - total[u]
        if kind == 5:
            return current[u] if u in current else -1000.0 * (i + 1) + inside[u]
        return float((i + 1) * inside[u])

    heap: list[tuple[float, int]] = [(0.0, source)]
    while len(placed) < len(nbrs):
        if not heap:
            v = min(u for u in nbrs if u not in placed)
            current[v] = 0.0
            heap = [(0.0, v)]
        key, v = heapq.heappop(heap)
        if v in placed or current.get(v) != -key:
            continue
        i = len(placed)
        placed[v] = i
        for u in nbrs[v]:
            if u in placed:
                continue
            inside[u] += 1
            total[u] += i
            new = score(u, i)
            if current.get(u) != new:
                current[u] = new
                heapq.heappush(heap, (-new, u))
    return sorted(placed, key=placed.get)


def best_first_order(edges: DataFrame, source: int, kind: int = 2, matrix: bool = False) -> DataFrame:
    """(id, component, place): best-first order of each component, that of ``source`` from there and others
    from their smallest id (G7); of equal scores the smallest id.

    A vertex is scored when a neighbour is placed.  Kinds: 1 depth-first like, 2 most placed neighbours,
    3 root of the sum of places of placed neighbours (``matrix``: the sum itself), 4 sum of the gaps since
    they were placed, 5 breadth-first with degree as priority, 6 place of the last placed neighbour times
    their number.

    The order is sequential by nature, so a component is one task's work and must fit in its memory;
    components run side by side.  They are dealt into as many tasks as the number of edges asks for, and a
    task reads its edges in order of component, so it holds one component and a batch, however many there are.
    Edges with a null end are ignored.
    """
    if kind not in range(1, 7):
        raise ValueError("kind is 1 to 6")
    ends = _dealt(edges, "src", "dst").where("src is not null and dst is not null").select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    rows = stored(ends.distinct(), "ends")
    n = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // PER_ORDER))
    comp = connected_components(rows).withColumnRenamed("id", "src")
    schema = "id bigint, component bigint, place bigint"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, out = ["id", "component", "place"], []
        lines = (line for b in batches for line in zip(b["component"].tolist(), b["src"].tolist(), b["dst"].tolist()))
        for component, inside in groupby(lines, itemgetter(0)):
            nbrs: dict[int, list[int]] = {}
            ids: dict[int, int] = {}  # one number for each vertex, not one for each edge
            for _, s, d in inside:
                s, d = ids.setdefault(s, s), ids.setdefault(d, d)
                nbrs.setdefault(s, [])
                nbrs.setdefault(d, [])
                if s != d:
                    nbrs[s].append(d)
            for v in nbrs.values():
                v.sort()
            order = _best_first(nbrs, source if source in nbrs else min(nbrs), kind, matrix)
            for place, v in enumerate(order):
                out.append((v, component, place))
                if len(out) == BATCH:
                    yield pd.DataFrame(out, columns=names)
                    out.clear()
        if out:
            yield pd.DataFrame(out, columns=names)

    return rows.join(comp, "src").repartition(n, "component").sortWithinPartitions("component").mapInPandas(run, schema)
