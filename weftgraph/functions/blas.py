"""Reductions and maps of vectors, as rows (i, x) or as array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reductions(v: DataFrame, i: str = "i", x: str = "x") -> DataFrame:
    """(max, min, argmax, argmin, sum, norm2) of a vector in rows; the first of equals; max and min of none are 0."""
    first = lambda c: F.min_by(i, F.struct(c, F.col(i)))
    return v.agg(
        F.coalesce(F.max(x), F.lit(0)).alias("max"), F.coalesce(F.min(x), F.lit(0)).alias("min"), first(-F.col(x)).alias("argmax"), first(F.col(x)).alias("argmin"),
        F.coalesce(F.sum(x), F.lit(0)).alias("sum"), F.sqrt(F.coalesce(F.sum(F.col(x) * F.col(x)), F.lit(0.0))).alias("norm2"),
    )


def argmax_n(v: DataFrame, n: int, i: str = "i", x: str = "x") -> DataFrame:
    """(i): where the n-th largest value is, ties by i."""
    top = v.orderBy(F.col(x).desc(), i).limit(n)
    return top.withColumn("_r", F.row_number().over(Window.orderBy(F.col(x).desc(), i))).where(F.col("_r") == n).select(i)


def dot(a: DataFrame, b: DataFrame, i: str = "i", x: str = "x") -> DataFrame:
    """(dot)"""
    return a.join(b.withColumnRenamed(x, "_y"), i).agg(F.coalesce(F.sum(F.col(x) * F.col("_y")), F.lit(0.0)).alias("dot"))


def incset(n: int | Column, base: int = 0) -> Column:
    """base, base + 1, ... as an array of n."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.when(n <= 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(base), n + base - 1))


def scaled(a: Column | str, alpha: float) -> Column:
    return F.transform(a, lambda x: x * alpha)


def axpy(alpha: float, x: Column | str, y: Column | str) -> Column:
    """y + alpha x"""
    return F.zip_with(x, y, lambda p, q: q + alpha * p)


def array_dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x * y).cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def array_norm2(a: Column | str) -> Column:
    return F.sqrt(array_dot(a, a))


def _search(a: Column | str, before) -> Column:
    """How many elements of a sorted array ``before`` holds for, which are its first: a step for each bit of the size.

    The place goes up by a power of two where the element in front of the new place is one of them; there
    is nothing to branch on, and 31 steps do for any array.
    """
    a = F.col(a) if isinstance(a, str) else a
    steps = F.sequence(F.ceil(F.log2(F.size(a) + 1)).cast("int") - 1, F.lit(0), F.lit(-1))

    def step(at: Column, bit: Column) -> Column:
        to = at + F.pow(F.lit(2), bit).cast("int")
        return at + F.when((to <= F.size(a)) & before(F.get(a, to - 1)), to - at).otherwise(0)

    return F.when(F.size(a) > 0, F.aggregate(steps, F.lit(0), step)).when(F.size(a) == 0, 0)


def lower_bound(a: Column | str, value: Column) -> Column:
    """How many elements of a sorted array are below ``value``."""
    return _search(a, lambda x: x < value)


def upper_bound(a: Column | str, value: Column) -> Column:
    """How many elements of a sorted array are not above ``value``."""
    return _search(a, lambda x: x <= value)


def place_of(a: Column | str, value: Column) -> Column:
    """The 0-based place of ``value`` in a sorted array, -1 if it is not there."""
    at = lower_bound(a, value)
    return F.when(F.get(a, at) == value, at).otherwise(F.when(F.col(a).isNotNull() if isinstance(a, str) else a.isNotNull(), F.lit(-1)))


def top_k(df: DataFrame, k: int, key: str, largest: bool = True, per: list[str] | None = None, tie: str | None = None) -> DataFrame:
    """The k rows of the largest (smallest) keys, of all or of each group."""
    order = [F.col(key).desc() if largest else F.col(key).asc(), *([F.col(tie)] if tie else [])]
    if per is None:
        return df.orderBy(*order).limit(k)
    rank = F.row_number().over(Window.partitionBy(*per).orderBy(*order))
    return df.withColumn("_r", rank).where(F.col("_r") <= k).drop("_r")
