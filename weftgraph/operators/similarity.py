"""Similarity of sparse rows and nearest neighbours, through the inverted index: rows that share a column meet."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.operators.matrix import normalise, transpose
from weftgraph.operators.ordering import running_sum
from weftgraph.storage import stored

KINDS = ("dotp", "cos", "jac", "min", "amin")


def _score(kind: str) -> Column:
    """From dot, low (sum of minima), sa, sb (sums), qa, qb (squared norms)."""
    dot, low, sa, sb, qa, qb = (F.col(c) for c in ("dot", "low", "sa", "sb", "qa", "qb"))
    scores = {
        "dotp": dot,
        "cos": F.try_divide(dot, F.sqrt(qa * qb)),
        "jac": F.try_divide(dot, qa + qb - dot),
        "min": F.try_divide(low, sa + sb - low),
        "amin": F.try_divide(low, sa),
    }
    if kind not in scores:
        raise ValueError(f"kind must be one of {KINDS}")
    return F.coalesce(scores[kind], F.lit(0.0))


def _totals(m: DataFrame, id_: str, suffix: str) -> DataFrame:
    return m.groupBy(F.col("row").alias(id_)).agg(F.sum("val").alias(f"s{suffix}"), F.sum(F.col("val") * F.col("val")).alias(f"q{suffix}"))


#: From so many entries of its most frequent column on a matrix is searched by bounds.
OFTEN = 10_000


def _by_bound(m: DataFrame, df: DataFrame, kind: str, least: float, most: float) -> DataFrame:
    """``m`` (id, col, x) with ``_skip`` and ``_rest``, columns taken from the most frequent one on.

    ``_skip``: the entries up to this one can't make up ``least`` whatever they meet; ``_rest``: how much
    those of the row can give at most.  For cos, and for jac, which is no larger, a row's entries count by
    their norm over its own; for dotp by their norm times ``most``, the largest norm of the other side;
    for min and amin by their sum over the row's.
    """
    whole, upto = Window.partitionBy("id"), Window.partitionBy("id").orderBy(F.col("_df").desc(), "col")
    size = F.greatest("x", F.lit(0.0)) if kind in ("min", "amin") else F.col("x") * F.col("x")
    own = m.join(df, "col").withColumn("_run", F.sum(size).over(upto))
    if kind == "dotp":
        gives = F.sqrt("_run") * F.lit(most)
    else:
        own = own.withColumn("_all", F.sum("x" if kind in ("min", "amin") else size).over(whole))
        share = F.coalesce(F.try_divide(F.col("_run"), F.col("_all")), F.lit(float("inf")))
        gives = F.when(F.col("_all") > 0, share if kind in ("min", "amin") else F.sqrt(share)).otherwise(F.lit(float("inf")))
    own = own.withColumn("_gives", gives).withColumn("_skip", F.col("_gives") < F.lit(least * (1 - 1e-9)))  # a little less, for rounding
    return own.select("id", "col", "x", "_skip", F.coalesce(F.max(F.when(F.col("_skip"), F.col("_gives"))).over(whole), F.lit(0.0)).alias("_rest"))


def _norm(m: DataFrame) -> float:
    return m.groupBy("row").agg(F.sqrt(F.sum(F.col("val") * F.col("val"))).alias("n")).agg(F.max("n")).first()[0] or 0.0


def candidates(queries: DataFrame, m: DataFrame, kind: str, least: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs (query, row), entries of the queries (id, col, x, _skip, _rest), those of ``m``): the pairs that may
    reach ``least`` > 0 (N3).

    Columns are in one order, the most frequent first.  Of each row the longest beginning that can't
    give ``least`` by itself is left out.  The rarest column that a pair shares lies in neither beginning
    if the pair reaches ``least``, so only what is left over is joined: frequent columns bring nobody together.
    A pair then has a partial score, and goes on only if that and what the beginnings can give reach ``least``.
    """
    df = m.groupBy("col").agg(F.count(F.lit(1)).alias("_df"))
    big = (_norm(m), _norm(queries)) if kind == "dotp" else (1.0, 1.0)
    entries = lambda x: x.select(F.col("row").alias("id"), "col", F.col("val").alias("x"))
    q = stored(_by_bound(entries(queries), df, kind, least, big[0]), "bounded")
    c = stored(_by_bound(entries(m), df, kind, 0.0 if kind == "amin" else least, big[1]), "bounded")  # amin says nothing of the other row's sum
    left = q.where("not _skip").select(F.col("id").alias("query"), "col", "x", F.col("_rest").alias("_ra"))
    right = c.where("not _skip").select(F.col("id").alias("row"), "col", F.col("x").alias("y"), F.col("_rest").alias("_rb"))
    met = left.join(right, "col").groupBy("query", "row").agg(F.sum(F.col("x") * F.col("y")).alias("dot"), F.max(F.greatest("_ra", "_rb")).alias("_rest"))
    if kind in ("cos", "jac"):
        met = met.join(_totals(queries, "query", "a"), "query").join(_totals(m, "row", "b"), "row")
        met = met.withColumn("dot", F.coalesce(F.try_divide("dot", F.sqrt(F.col("qa") * F.col("qb"))), F.lit(0.0)))
    # what isn't in both parts lies in the beginning that goes on longer, and gives no more than that one's bound
    if kind in ("dotp", "cos", "jac"):
        met = met.where(F.col("dot") + F.col("_rest") >= F.lit(least * (1 - 1e-9)))
    return met.select("query", "row"), q, c


def neighbours(queries: DataFrame, m: DataFrame, kind: str = "cos", k: int | None = 100, least: float = 0.25, often: int | None = None) -> DataFrame:
    """(query, row, sim) with sim >= least, the k best of each query by sim, then row.

    ``queries`` and ``m`` are entries; a row of both may match itself.  ``k`` None keeps all.  Rows meet
    in the columns that they share.  Where a column has ``often`` (``OFTEN``) entries or more and ``least`` is
    above 0, only ``candidates`` are scored, in full; the result is the same but for the order of sums.
    """
    q = queries.select(F.col("row").alias("query"), "col", F.col("val").alias("x"))
    c = m.select("row", "col", F.col("val").alias("y"))
    sums = lambda pairs: pairs.groupBy("query", "row").agg(F.sum(F.col("x") * F.col("y")).alias("dot"), F.sum(F.least("x", "y")).alias("low"))
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}")
    bounded = least > 0 and not c.groupBy("col").count().where(F.col("count") >= (OFTEN if often is None else often)).isEmpty()
    if bounded and kind in ("min", "amin"):
        bounded = m.where("val < 0").isEmpty() and queries.where("val < 0").isEmpty()
    if bounded:
        pairs, own, theirs = candidates(queries, m, kind, least)
        pairs = stored(pairs, "candidates")
        met = sums(pairs.join(own.select(F.col("id").alias("query"), "col", "x"), "query").join(theirs.select(F.col("id").alias("row"), "col", F.col("x").alias("y")), ["row", "col"]))
    else:
        met = sums(q.join(c, "col"))
    if kind == "dotp":  # needs no totals
        scored = met.select("query", "row", F.coalesce("dot", F.lit(0.0)).alias("sim"))
    else:
        scored = met.join(_totals(queries, "query", "a"), "query").join(_totals(m, "row", "b"), "row").select("query", "row", _score(kind).alias("sim"))
    out = scored.where(F.col("sim") >= least)
    if k is None:
        return out
    order = Window.partitionBy("query").orderBy(F.col("sim").desc(), "row")
    return out.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).select("query", "row", "sim")


def pair_similarity(a: DataFrame, b: DataFrame, pairs: DataFrame, kind: str = "cos", compat: bool = False) -> DataFrame:
    """(i1, i2, sim) of the given pairs of rows of a and b.

    ``compat`` leaves out what lies behind the smaller of the two rows' last columns, as a merge does
    that stops at the end of one list.
    """
    left = pairs.join(a.select(F.col("row").alias("i1"), "col", F.col("val").alias("x")), "i1")
    right = pairs.join(b.select(F.col("row").alias("i2"), "col", F.col("val").alias("y")), "i2")
    both = left.join(right, ["i1", "i2", "col"], "full").select("i1", "i2", "col", F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("y", F.lit(0.0)).alias("y"), F.col("x").isNotNull().alias("hx"), F.col("y").isNotNull().alias("hy"))
    if compat:
        ends = both.groupBy("i1", "i2").agg(F.least(F.max(F.when(F.col("hx"), F.col("col"))), F.max(F.when(F.col("hy"), F.col("col")))).alias("_end"))
        both = both.join(ends, ["i1", "i2"]).where(F.col("col") <= F.col("_end"))
    sq = lambda c: F.sum(F.col(c) * F.col(c))
    sums = both.groupBy("i1", "i2").agg(
        F.sum(F.col("x") * F.col("y")).alias("dot"), F.sum(F.least("x", "y")).alias("low"), F.sum("x").alias("sa"), F.sum("y").alias("sb"), sq("x").alias("qa"), sq("y").alias("qb")
    )
    # rows without entries are as far from each other as rows that share nothing
    return pairs.select("i1", "i2").distinct().join(sums, ["i1", "i2"], "left").select("i1", "i2", _score(kind).alias("sim"))


#: Entries of the rows of a block, about, list entries that a block takes at a time, about, and meetings that a task has in arrays at a time.
BLOCK, LISTED, AT_ONCE = 100_000, 4_000_000, 1_000_000
#: Entries of a task that makes lists; each goes to several blocks.
PER_TASK = 250_000

_SUMS = "side string, id bigint, dot double, _p double, _q double"


def _meet(group: pa.Table) -> pa.Table:
    """``_SUMS`` of one block of rows (q) with the rows (o) of their columns' lists.

    An ``o`` behind the block meets its rows here only, so it gets its share as well; one of the block meets
    them from either side.
    """
    flat = lambda c: group[c].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    over = lambda squares: np.where(squares > 0, squares, np.inf)  # noqa: E731  # what is all zeros is like nothing
    col, ca, cb = group["col"].to_numpy(), over(group["ca"].to_numpy()), over(group["cb"].to_numpy())
    at = np.repeat(np.arange(len(col)), pc.list_value_length(group["q_row"]).to_numpy())
    many = pc.list_value_length(group["o_row"]).to_numpy().astype(np.int64)
    start = np.cumsum(many) - many
    qs, q = np.unique(flat("q_row"), return_inverse=True)
    os_, o = np.unique(flat("o_row"), return_inverse=True)
    qa, qb, oa, ob = flat("q_a"), flat("q_b"), flat("o_a"), flat("o_b")

    def squares(n: int, code: np.ndarray, name: str) -> np.ndarray:
        out = np.zeros(n)
        out[code] = flat(name)
        return over(out)

    nqa, nqb, noa, nob = squares(len(qs), q, "q_sa"), squares(len(qs), q, "q_sb"), squares(len(os_), o, "o_sa"), squares(len(os_), o, "o_sb")
    later = ~np.isin(os_, qs)
    by_q, by_o, by_col = np.zeros((3, len(qs))), np.zeros((3, len(os_))), np.zeros((3, len(col)))

    order = np.argsort(q, kind="stable")
    done = np.cumsum(many[at[order]])  # meetings up to each entry, whole rows q at a time
    ends = np.flatnonzero(np.diff(q[order], append=-1)) + 1
    first = 0
    while first < len(order):
        limit = (done[first - 1] if first else 0) + AT_ONCE
        fit = ends[(ends > first) & (done[ends - 1] <= limit)]
        last = fit[-1] if len(fit) else ends[np.searchsorted(ends, first, side="right")]
        e = order[first:last]
        first = last
        n = many[at[e]]
        left = np.repeat(e, n)
        right = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[at[e]], n)
        pair, which = np.unique(q[left] * len(os_) + o[right], return_inverse=True)
        if not len(pair):
            continue
        i, j, c = pair // len(os_), pair % len(os_), at[left]
        total = lambda w: np.bincount(which, w, len(pair))
        aa, bb, ab, ba = qa[left] * oa[right], qb[left] * ob[right], qa[left] * ob[right], qb[left] * oa[right]
        # rows: cosines in a and in b
        p, r = total(aa) / np.sqrt(nqa[i] * noa[j]), total(bb) / np.sqrt(nqb[i] * nob[j])
        for k, v in enumerate((p * r, p * p, r * r)):
            by_q[k] += np.bincount(i, v, len(qs))
            by_o[k] += np.bincount(j, v * later[j], len(os_))
        # columns: a quadratic form over pairs of rows
        both = np.sqrt(ca[c] * cb[c])
        aa, bb, ab, ba = aa / ca[c], bb / cb[c], ab / both, ba / both
        twice = later[o[right]]
        by_col[0] += np.bincount(c, ab * total(ab)[which] + twice * ba * total(ba)[which], len(col))
        by_col[1] += np.bincount(c, (1 + twice) * aa * total(aa)[which], len(col))
        by_col[2] += np.bincount(c, (1 + twice) * bb * total(bb)[which], len(col))
    parts = [("rows", qs, by_q), ("rows", os_[later], by_o[:, later]), ("cols", col, by_col)]
    return pa.table({"side": np.concatenate([np.full(len(x), s) for s, x, _ in parts]), "id": np.concatenate([x for _, x, _ in parts]), **{n: np.concatenate([v[k] for *_, v in parts]) for k, n in enumerate(("dot", "_p", "_q"))}})


def _sizes(a: DataFrame, b: DataFrame, by: str) -> tuple[DataFrame, int, int]:
    """((id, n), the sum of n, that of their squares): how many entries a row or column has, in the fuller matrix."""
    ones = a.select(by, F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(b.select(by, F.lit(0).alias("x"), F.lit(1).alias("y")))
    sizes = stored(ones.groupBy(by).agg(F.greatest(F.sum("x"), F.sum("y")).alias("n")), "sizes")
    n, squares = sizes.agg(F.sum("n"), F.sum(F.col("n").cast("decimal(38,0)") * F.col("n"))).first()
    return sizes, int(n or 0), int(squares or 0)


def _sums(a: DataFrame, b: DataFrame, sizes: DataFrame, n: int, squares: int) -> DataFrame:
    """``_SUMS`` of rows and columns of stored matrices, to be added up by side and id, through meetings of rows in columns.

    Rows go in blocks of neighbouring ids, some ``BLOCK`` entries each.  A block gets the list of a column once, however many
    of its rows have the column, and of the list what doesn't lie before the block.  Where lists are long, they go
    to a block in pieces; sums over the rows met add up.
    """
    spark = a.sparkSession
    block = F.floor(F.col("_before") / BLOCK).alias("_block")
    ranges = running_sum(sizes, F.col("n"), "row", name="_before", inclusive=False).select("row", block)
    blocks = stored(ranges.select("row", F.min("row").over(Window.partitionBy("_block")).alias("block")), "blocks")
    value = lambda m, x, y: m.select("row", "col", F.coalesce(x, F.lit(0.0)).alias("a"), F.coalesce(y, F.lit(0.0)).alias("b"))
    rows = value(a, F.col("val"), F.lit(0.0)).unionByName(value(b, F.lit(0.0), F.col("val")))
    rows = rows.join(blocks.hint("merge"), "row").groupBy("block", "row", "col").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    square = lambda c, by: F.sum(F.col(c) * F.col(c)).over(Window.partitionBy(by))
    rows = stored(rows.withColumns({"sa": square("a", "row"), "sb": square("b", "row")}), "dealt")

    tasks = max(spark.sparkContext.defaultParallelism, -(-n // PER_TASK))
    pieces = max(1, -(-min(n, BLOCK * squares // max(n, 1)) // LISTED))
    rows = rows.repartition(tasks, "col").withColumns({"ca": square("a", "col"), "cb": square("b", "col")})
    entry = F.collect_list(F.struct("row", "a", "b", "sa", "sb"))
    lists = rows.groupBy("col", F.pmod(F.xxhash64("row"), F.lit(pieces)).alias("piece")).agg(entry.alias("o"))
    own = rows.groupBy("col", "block").agg(entry.alias("q"), F.first("ca").alias("ca"), F.first("cb").alias("cb"))
    met = own.join(lists.hint("merge"), "col").withColumn("o", F.filter("o", lambda x: x["row"] >= F.col("block"))).where(F.size("o") > 0)
    fields = [F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in "qo" for c in ("row", "a", "b", "sa", "sb")]
    dealt = met.select("block", "piece", "col", "ca", "cb", *fields)
    return dealt.groupBy("block", "piece").applyInArrow(_meet, _SUMS)


def compare_neighbourhoods(a: DataFrame, b: DataFrame, k: int | None = None, least: float = 0.0, form: str | None = None) -> DataFrame:
    """(side, mean): how alike the neighbours of a row are in a and in b.

    Each row's neighbours, itself among them, are a vector of cosines of at least ``least``; ``k`` None
    keeps all, else the k best count.  The mean is over the rows that have entries in both matrices;
    where their lists don't meet the row counts as 0.  ``rows`` compares rows, ``cols`` columns.

    Where all neighbours count and no value is negative, one pass does both sides and makes no row for a pair:
    where rows q and o meet, a task has their cosines, and with unit columns the sum over columns c of
    (a_p . a_c) (b_p . b_c) is a quadratic form of a_p and b_p over the same pairs of rows.  Rows meet in columns
    (``form`` "rows") or columns in rows ("columns"); left out, that of the smaller sum of squared sizes is taken.
    Entries of the same place count as their sum.
    """
    a, b = stored(a.select("row", "col", "val"), "entries"), stored(b.select("row", "col", "val"), "entries")
    common = lambda x, y: x.select(F.col("row").alias("query")).distinct().intersect(y.select(F.col("row").alias("query")))
    plain = k is None and least <= 0 and a.where("val < 0").isEmpty() and b.where("val < 0").isEmpty()

    def mean(common: DataFrame, sums: DataFrame, side: str) -> DataFrame:
        cos = F.coalesce(F.try_divide(F.col("dot"), F.sqrt(F.col("_p") * F.col("_q"))), F.lit(0.0))
        return common.join(sums, "query", "left").agg(F.avg(F.coalesce(cos, F.lit(0.0))).alias("mean")).select(F.lit(side).alias("side"), "mean")

    if plain:
        by_row, n, row_squares = _sizes(a, b, "row")
        by_col, _, col_squares = _sizes(a, b, "col")
        flip = form == "columns" or (form is None and row_squares < col_squares)
        if flip:
            sums = _sums(transpose(a), transpose(b), by_col.withColumnRenamed("col", "row"), n, row_squares)
        else:
            sums = _sums(a, b, by_row, n, col_squares)
        sums = stored(sums.groupBy("side", F.col("id").alias("query")).agg(*[F.sum(c).alias(c) for c in ("dot", "_p", "_q")]), "sums")
        of = lambda side: sums.where(F.col("side") == side).drop("side")
        sides = ("cols", "rows") if flip else ("rows", "cols")
        return mean(common(a, b), of(sides[0]), "rows").unionByName(mean(common(transpose(a), transpose(b)), of(sides[1]), "cols"))

    def scored(x: DataFrame, y: DataFrame, side: str) -> DataFrame:
        both = stored(common(x, y), "common")

        def scores(m: DataFrame, name: str) -> DataFrame:
            unit = stored(normalise(m), "unit")
            asked = unit.join(both, unit["row"] == both["query"], "left_semi")
            return neighbours(asked, unit, "dotp", k, least).withColumnRenamed("sim", name)

        met = scores(x, "p").join(scores(y, "q"), ["query", "row"], "full").groupBy("query")
        sums = met.agg(F.sum(F.col("p") * F.col("q")).alias("dot"), F.sum(F.col("p") * F.col("p")).alias("_p"), F.sum(F.col("q") * F.col("q")).alias("_q"))
        return mean(both, sums, side)

    return scored(a, b, "rows").unionByName(scored(transpose(a), transpose(b), "cols"))
