"""Edge lists: cleaning, degrees, orientation, adjacency, relabelling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.operators.ordering import running_sum, with_rank


def canonical(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(u, v) with u <= v for each row (P1); null ends are dropped."""
    return edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(F.least(src, dst).alias("u"), F.greatest(src, dst).alias("v"))


def clean(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """The simple graph of a dirty bag: no loops, each edge once, u < v."""
    return canonical(edges, src, dst).where("u <> v").distinct()


def max_ids(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(max_id, n_dense) of the uncleaned list (A11): ids run from 0, and isolated ones count."""
    top = F.max(F.greatest(src, dst)).cast("long")
    return edges.agg(top.alias("max_id"), F.coalesce(top + 1, F.lit(0)).alias("n_dense"))


def num_vertices(edges: DataFrame, mode: str = "dense", src: str = "src", dst: str = "dst") -> DataFrame:
    """(n): ids up to the largest (``dense``) or ids that occur (``observed``)."""
    if mode == "dense":
        return max_ids(edges, src, dst).select(F.col("n_dense").alias("n"))
    ends = edges.select(F.explode(F.array(src, dst)).alias("id")).where("id is not null")
    return ends.agg(F.count_distinct("id").alias("n"))


def degrees(graph: DataFrame, keep: Column | None = None) -> DataFrame:
    """(id, degree) over clean edges (u, v), of those that ``keep`` holds for."""
    rows = graph if keep is None else graph.where(keep)
    return rows.select(F.explode(F.array("u", "v")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def block_bits(sizes: DataFrame, most: int) -> int:
    """The largest k up to 24 with which no block of 2**k neighbouring ids has more than ``most`` in sum over its rows
    (id, n); 0 if there is none.  Blocks dealt by hash keep ids together that often share neighbours, and no task
    gets much more than another, however ids are spread."""
    blocks = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.shiftright("id", k).alias("b")) for k in range(2, 25, 2)]))
    sums = sizes.select(blocks.alias("x"), "n").groupBy("x.k", "x.b").agg(F.sum("n").alias("n"))
    return sums.groupBy("k").agg(F.max("n").alias("n")).where(F.col("n") <= most).agg(F.max("k")).first()[0] or 0


def histogram(df: DataFrame, bucket: Column) -> DataFrame:
    """(bucket, n) of any key expression."""
    return df.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def oriented(graph: DataFrame, deg: DataFrame | None = None) -> DataFrame:
    """(s, t, ds, dt): each edge from its end of lower (degree, id) to the other.

    The order is total, so the result has no cycle, and out-degrees are at most sqrt(2 m).
    """
    deg = degrees(graph) if deg is None else deg
    du, dv = (deg.select(F.col("id").alias(c), F.col("degree").alias(f"d{c}")) for c in "uv")
    both = graph.join(du, "u").join(dv, "v")
    first = F.struct("du", "u") < F.struct("dv", "v")
    pick = lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b))
    return both.select(pick("u", "v").alias("s"), pick("v", "u").alias("t"), pick("du", "dv").alias("ds"), pick("dv", "du").alias("dt"))


def out_degrees(directed: DataFrame) -> DataFrame:
    """(s, out_degree)."""
    return directed.groupBy("s").agg(F.count(F.lit(1)).alias("out_degree"))


def both_directions(graph: DataFrame) -> DataFrame:
    """(src, dst) in both directions."""
    return graph.select(F.col("u").alias("src"), F.col("v").alias("dst")).unionByName(graph.select(F.col("v").alias("src"), F.col("u").alias("dst")))


def adjacency(graph: DataFrame, chunk: int | None = None) -> DataFrame:
    """(id, nbrs): sorted neighbours (G1, P22).  A row holds one vertex's neighbours.

    With ``chunk``, (id, part, nbrs): those of a vertex of more than ``chunk`` neighbours are dealt by hash
    into parts of about as many, so no row and no task grows with a hub.
    """
    both = both_directions(graph)
    if chunk is None:
        return both.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list("dst")).alias("nbrs"))
    dealt = both.join(degrees(graph).withColumnRenamed("id", "src"), "src")
    part = F.pmod(F.xxhash64("dst"), F.ceil(F.col("degree") / F.lit(chunk))).cast("int")
    return dealt.groupBy(F.col("src").alias("id"), part.alias("part")).agg(F.sort_array(F.collect_list("dst")).alias("nbrs"))


def csr_offsets(deg: DataFrame) -> DataFrame:
    """(id, degree, begin): where a vertex's neighbours begin in one array of all."""
    return running_sum(deg, F.col("degree"), "id", name="begin", inclusive=False)


def relabel_by_degree(deg: DataFrame, descending: bool = True) -> DataFrame:
    """(old_id, new_id): dense ranks by degree, ties by id (W4, W5; ascending: W6)."""
    key = F.col("degree").desc() if descending else F.col("degree").asc()
    return with_rank(deg, key, F.col("id").asc(), name="new_id").select(F.col("id").alias("old_id"), "new_id")


def reorder(graph: DataFrame, perm: DataFrame, a: str = "u", b: str = "v") -> DataFrame:
    """Edges with new ids by ``perm`` (old_id, new_id); other columns follow."""
    pa, pb = (perm.select(F.col("old_id").alias(c), F.col("new_id").alias(f"_{c}")) for c in (a, b))
    rest = [c for c in graph.columns if c not in (a, b)]
    return graph.join(pa, a).join(pb, b).select(F.col(f"_{a}").alias(a), F.col(f"_{b}").alias(b), *rest)


def invert(perm: DataFrame) -> DataFrame:
    """The other way round: one of two maps may be left out (P20)."""
    return perm.select(F.col("new_id").alias("old_id"), F.col("old_id").alias("new_id"))


def extract_subgraph(edges: DataFrame, start: int, n: int) -> DataFrame:
    """Rows of the n vertices from ``start`` on, numbered from 0; the other ends keep their ids."""
    return edges.where(F.col("src").between(start, start + n - 1)).withColumn("src", F.col("src") - start)


def degree_skew(deg: DataFrame, top: int, every: int) -> DataFrame:
    """(rank, cumulative, share): the degree sum of the r vertices of highest degree for r = every, 2 every,
    ... up to ``top``, and its ratio to the number of edges (A12)."""
    edges = deg.agg((F.sum("degree") / 2).alias("m"))
    best = deg.orderBy(F.col("degree").desc(), "id").limit(top)  # top-k, bounded by `top`
    order = Window.orderBy(F.col("degree").desc(), "id")
    run = best.select(F.row_number().over(order).alias("rank"), F.sum("degree").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("cumulative"))
    return run.where(F.col("rank") % every == 0).crossJoin(F.broadcast(edges)).select(F.col("rank").cast("long").alias("rank"), "cumulative", (F.col("cumulative") / F.col("m")).alias("share"))


def group_ids(df: DataFrame, set_col: str, id_col: str) -> DataFrame:
    """(set, ids): sorted element ids of each set."""
    return df.groupBy(F.col(set_col).alias("set")).agg(F.sort_array(F.collect_list(id_col)).alias("ids"))


def range_buckets(df: DataFrame, key: str, n: int | None = None) -> DataFrame:
    """Rows dealt into ranges of ``key`` and sorted inside: a bucket sort (O2, O3)."""
    dealt = df.repartitionByRange(n, key) if n else df.repartitionByRange(key)
    return dealt.sortWithinPartitions(key)
