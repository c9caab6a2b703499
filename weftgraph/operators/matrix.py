"""Sparse-matrix verbs on entries (row, col, val)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.operators.ordering import grouped_running_sum, with_rank
from weftgraph.storage import stored


def _axis(what: str) -> tuple[str, str]:
    if what not in ("row", "col"):
        raise ValueError("what must be 'row' or 'col'")
    return (what, "col" if what == "row" else "row")


def extract_submatrix(m: DataFrame, start: int, n: int) -> DataFrame:
    """n consecutive rows, numbered from 0."""
    return m.where(F.col("row").between(start, start + n - 1)).withColumn("row", F.col("row") - start)


def extract_rows(m: DataFrame, picks: DataFrame) -> DataFrame:
    """Rows in the order of ``picks`` (pos, row), repeats allowed."""
    return m.join(picks.select("row", "pos"), "row").select(F.col("pos").alias("row"), "col", "val")


def extract_partition(m: DataFrame, parts: DataFrame, pid: int) -> DataFrame:
    """Rows whose ``parts`` (row, part) is pid, numbered from 0 in order."""
    mine = with_rank(parts.where(F.col("part") == pid).select("row"), "row", name="new")
    return m.join(mine, "row").select(F.col("new").alias("row"), "col", "val")


def split(m: DataFrame, colour: Column) -> DataFrame:
    """Entries with the colour that routes each; shapes stay (P10)."""
    return m.select(colour.alias("colour"), "row", "col", "val")


def prune(m: DataFrame, what: str, low: int, high: int) -> DataFrame:
    """Entries of rows or columns with low to high entries; numbers stay.

    Counts are aggregated and joined back, so a hot row never is one task's whole work.
    """
    key, _ = _axis(what)
    good = m.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n").between(low, high)).select(key)
    return m.join(good, key, "left_semi").select("row", "col", "val")


def low_filter(m: DataFrame, what: str, norm: int, fraction: float) -> DataFrame:
    """Per row or column, largest values first, entries before which at most ``fraction`` of the whole sum
    (norm 1) or squared sum (norm 2) lies; the entry that crosses it stays (P12).

    Entries are range-partitioned by key and value, so a hot key is many tasks' work.
    """
    key, other = _axis(what)
    size = F.col("val") if norm == 1 else F.col("val") * F.col("val")
    rows = grouped_running_sum(m.select("row", "col", "val"), size, [key], F.col("val").desc(), F.col(other))
    return rows.where(F.col("_before") <= F.col("_total") * fraction).select("row", "col", "val")


def top_k_plus(m: DataFrame, what: str, k: int, keep: float) -> DataFrame:
    """The k largest per row or column, and all others of at least ``keep``.

    The k largest are found by a rank alone, of which each task passes on no more than k for a key.
    """
    key, other = _axis(what)
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col("val").desc(), other))
    least = F.coalesce(F.col("val") >= keep, F.lit(False))
    best = m.withColumn("_r", rank).where(F.col("_r") <= k).where(~least)
    return best.select("row", "col", "val").unionByName(m.where(least).select("row", "col", "val"))


def z_score_filter(m: DataFrame, z: float) -> DataFrame:
    """Entries above z / (entries of the row)."""
    n = m.groupBy("row").agg(F.count(F.lit(1)).alias("_n"))
    return m.join(n, "row").where(F.col("val") > F.lit(z) / F.col("_n")).select("row", "col", "val")


def compact_columns(m: DataFrame) -> DataFrame:
    """Columns that have entries, numbered by falling frequency, ties by column."""
    ids = with_rank(m.groupBy("col").agg(F.count(F.lit(1)).alias("n")), F.col("n").desc(), F.col("col"), name="new").select("col", "new")
    return m.join(ids, "col").select("row", F.col("new").alias("col"), "val")


def transpose(m: DataFrame) -> DataFrame:
    """(P16, S11, N5)"""
    return m.select(F.col("col").alias("row"), F.col("row").alias("col"), "val")


def shuffle(m: DataFrame, what: str, seed: int, symmetric: bool = False) -> DataFrame:
    """Rows, columns or both under a seeded random permutation (P17, O12); a square matrix can share one."""
    if what not in ("row", "col", "both"):
        raise ValueError("what must be 'row', 'col' or 'both'")

    def perm(keys: DataFrame, salt: int) -> DataFrame:
        return with_rank(keys.distinct(), F.md5(F.concat(F.lit(f"{seed}:{salt}:"), F.col("k").cast("string"))), F.col("k"), name="new")

    out = m
    if symmetric:
        shared = perm(m.select(F.explode(F.array("row", "col")).alias("k")), 0)
        tables = {"row": shared, "col": shared}
    else:
        tables = {c: perm(m.select(F.col(c).alias("k")), i) for i, c in enumerate(("row", "col")) if what in (c, "both")}
    for c, p in tables.items():
        # distinct keys take each other's places
        old = with_rank(p.select("k"), "k", name="new").withColumnRenamed("k", "to")
        out = out.join(p.join(old, "new").select(F.col("k").alias(c), F.col("to").alias(f"_{c}")), c).withColumn(c, F.col(f"_{c}")).drop(f"_{c}")
    return out.select("row", "col", "val")


def make_symmetric(m: DataFrame, op: str, compat: bool = False) -> DataFrame:
    """The matrix combined with its transpose by sum, min, max or avg.

    min keeps entries that are there both ways, the others all.  avg is (a + b) / 2 with 0 for a missing
    one; ``compat`` gives the uneven 0.25 a + 0.5 b where both are there.
    """
    flipped = m.select(F.col("col").alias("row"), F.col("row").alias("col"), F.col("val").alias("other"))
    both = m.join(flipped, ["row", "col"], "inner" if op == "min" else "full")
    a, b = F.coalesce("val", F.lit(0.0)), F.coalesce("other", F.lit(0.0))
    pair = F.col("val").isNotNull() & F.col("other").isNotNull()
    value = {
        "sum": a + b,
        "min": F.least("val", "other"),
        "max": F.greatest("val", "other"),
        "avg": F.when(pair, 0.25 * a + 0.5 * b).otherwise(0.5 * (a + b)) if compat else 0.5 * (a + b),
    }[op]
    return both.select("row", "col", value.alias("val"))


def _per(m: DataFrame, key: str, value: Column) -> DataFrame:
    return m.join(m.groupBy(key).agg(value.alias("_x")), key)


def scale(m: DataFrame, kind: str, n_rows: int | None = None) -> DataFrame:
    """Values scaled by maxtf, maxtf2, sqrt, pow25, pow65, pow75, pow85, log, idf or idf2.

    ``n_rows`` (idf kinds) defaults to the number of rows that have entries.
    """
    v = F.col("val")
    if kind in ("maxtf", "maxtf2"):
        a, b = (0.5, 0.5) if kind == "maxtf" else (0.1, 0.9)
        return _per(m, "row", F.max(F.abs(v))).select("row", "col", (a + b * F.try_divide(v, F.col("_x"))).alias("val"))
    if kind in ("sqrt", "pow25", "pow65", "pow75", "pow85"):
        p = 0.5 if kind == "sqrt" else int(kind[3:]) / 100
        return m.select("row", "col", F.when(v != 0, 0.1 + F.signum(v) * F.pow(F.abs(v), F.lit(p))).otherwise(v).alias("val"))
    if kind == "log":
        return m.select("row", "col", F.when(v != 0, 1 + F.signum(v) * F.log2(F.abs(v))).otherwise(v).alias("val"))
    if kind in ("idf", "idf2"):
        m = stored(m.select("row", "col", "val"), "entries")  # read three times
        df = m.groupBy("col").agg(F.count(F.lit(1)).alias("_df"))
        rows = df.agg(F.sum("_df").alias("_nnz"), F.count(F.lit(1)).alias("_cols"))
        seen = m.select("row").distinct().agg(F.count(F.lit(1)).alias("_rows")) if n_rows is None else None
        rows = rows.withColumn("_rows", F.lit(n_rows).cast("long")) if seen is None else rows.crossJoin(F.broadcast(seen))  # one row each
        full = m.join(df, "col").crossJoin(F.broadcast(rows))  # one row on the other side
        if kind == "idf":
            return full.select("row", "col", (v * F.log(F.col("_rows") / F.col("_df"))).alias("val"))
        bg = F.greatest(F.lit(10), F.floor(0.5 * F.col("_nnz") / F.col("_cols")))
        return full.select("row", "col", (v * F.log((F.col("_rows") + 2 * bg) / (bg + F.col("_df")))).alias("val"))
    raise ValueError(f"unknown kind {kind}")


def normalise(m: DataFrame, what: str = "row", norm: int = 2) -> DataFrame:
    """Rows or columns of unit 1-norm or 2-norm; those of norm zero become 0 (P25)."""
    key, _ = _axis(what)
    size = F.sum("val") if norm == 1 else F.sqrt(F.sum(F.col("val") * F.col("val")))
    return _per(m, key, size).select("row", "col", F.coalesce(F.try_divide(F.col("val"), F.col("_x")), F.lit(0.0)).alias("val"))


def sums(m: DataFrame, what: str = "row") -> DataFrame:
    """(A13)"""
    return m.groupBy(_axis(what)[0]).agg(F.sum("val").alias("sum"), F.count(F.lit(1)).alias("nnz"))


def norms(m: DataFrame, what: str = "row") -> DataFrame:
    """2-norms and their squares."""
    sq = F.sum(F.col("val") * F.col("val"))
    return m.groupBy(_axis(what)[0]).agg(F.sqrt(sq).alias("norm"), sq.alias("sq_norm"))


def sorted_rows(m: DataFrame, what: str = "row") -> DataFrame:
    """(key, entries): sorted (index, value) pairs of each row or column."""
    key, other = _axis(what)
    pairs = F.sort_array(F.collect_list(F.struct(F.col(other).alias("i"), F.col("val").alias("v"))))
    return m.groupBy(F.col(key).alias("key")).agg(pairs.alias("entries"))


def block_diagonal(m: DataFrame, copies: int, n_rows: int, n_cols: int) -> DataFrame:
    """Copies of a matrix along the diagonal."""
    return m.select(F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("k"), "row", "col", "val").select((F.col("row") + F.col("k") * n_rows).alias("row"), (F.col("col") + F.col("k") * n_cols).alias("col"), "val")


def unfold(t: DataFrame, n_i: int) -> DataFrame:
    """Tensor entries (k, i, j, v) as a matrix: row k * n_i + i, col j; repeats are counted."""
    return t.groupBy((F.col("k") * n_i + F.col("i")).alias("row"), F.col("j").alias("col")).agg(F.sum("v").alias("val"), F.count(F.lit(1)).alias("copies"))


def layered_graph(graph: DataFrame, copies: int, n: int) -> DataFrame:
    """(src, dst): copies of a clean graph as layers (S25), edges in both directions.

    Vertex v of layer c is v + c * n.  Layers have the graph's edges inside; a vertex is tied to itself
    in the next layer, and to those neighbours there whose place in its sorted list, from 0, and layer
    have an even sum.
    """
    from weftgraph.operators.edges import adjacency, both_directions

    at = lambda v, c: (F.col(v) + c * n)
    every, but_last = (F.explode(F.sequence(F.lit(0), F.lit(k))).alias("c") for k in (copies - 1, copies - 2))
    inside = both_directions(graph).select("src", "dst", every).select(at("src", F.col("c")).alias("src"), at("dst", F.col("c")).alias("dst"))
    if copies < 2:
        return inside
    lists = adjacency(graph)
    near = lists.select("id", F.posexplode("nbrs").alias("at", "nbr")).select("*", but_last).where((F.col("at") + F.col("c")) % 2 == 0)
    own = lists.select("id", F.col("id").alias("nbr"), but_last)
    up = near.select("id", "nbr", "c").unionByName(own).select(at("id", F.col("c")).alias("src"), at("nbr", F.col("c") + 1).alias("dst"))
    return inside.unionByName(up).unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
