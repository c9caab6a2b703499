"""Connected components by alternating large-star and small-star steps on edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.storage import discard, stored


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], int(row["h"] or 0)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(id, component) for each vertex of ``edges``; component is the smallest id reachable.

    Directions, loops and repeats don't matter; edges with a null end are ignored.  Each round hangs
    neighbours on the smallest vertex around, first those above a vertex, then those below; the number
    of rounds is logarithmic in practice.  Every round is a stored table, so nothing is recomputed and
    no vertex list reaches the driver.  The minimum of a neighbourhood is a combined aggregate, however
    many neighbours there are.
    """
    ends = edges.select(F.col(src).cast("long").alias("a"), F.col(dst).cast("long").alias("b")).where("a is not null and b is not null")
    seen = stored(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    loops = seen.where("u = v").select(F.col("u").alias("id"))
    now = seen.where("u <> v")
    mark = _mark(now)
    for round_ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        small_low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(small_low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = stored(small.unionByName(small_low.select("u", F.col("m").alias("v"))).distinct(), "cc")
        before, mark = mark, _mark(nxt)
        if round_:
            discard(now)
        now = nxt
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("id")).distinct()
    alone = roots.unionByName(loops).distinct().join(stars.select("id"), "id", "left_anti").select("id", F.col("id").alias("component"))
    return stars.unionByName(alone)
