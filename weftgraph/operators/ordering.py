"""Dense numbering and running sums over a total order, without a one-task window.

Rows are range-partitioned and sorted; the place of a row is its number in its partition plus the sizes
of the partitions before.  Only one number per partition goes through a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.storage import stored


def _sorted(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` with _part and _at of each row in the order; stored, so that both stay what they are."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_mono", F.monotonically_increasing_id()), "ordered")


def _offsets(parts: DataFrame, value: str) -> DataFrame:
    """(_part, _first, _before): the sum of ``value`` over earlier partitions; a row for each partition."""
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(parts.select("_part", "_first", F.coalesce(F.sum(value).over(ahead), F.lit(0)).alias("_before")))


def with_rank(df: DataFrame, *order: Column | str, name: str = "rank") -> DataFrame:
    """``df`` with a dense 0-based rank in the given order, which should be total."""
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    rows = _sorted(df, cols)
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_mono").alias("_first"))
    return rows.join(_offsets(sizes, "_n"), "_part").select(*df.columns, (F.col("_mono") - F.col("_first") + F.col("_before")).cast("long").alias(name))


def running_sums(df: DataFrame, values: dict[str, Column], *order: Column | str) -> DataFrame:
    """``df`` with a running sum for each name of ``values``, in one order, for which rows are sorted once."""
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    rows = _sorted(df.withColumns({f"_value_{i}": v for i, v in enumerate(values.values())}), cols)
    sums = rows.groupBy("_part").agg(*[F.sum(f"_value_{i}").alias(f"_n{i}") for i in range(len(values))])  # one row a partition
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("_part", *[F.coalesce(F.sum(f"_n{i}").over(ahead), F.lit(0)).alias(f"_before_{i}") for i in range(len(values))])
    upto = Window.partitionBy("_part").orderBy("_mono").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({f"_run_{i}": F.sum(f"_value_{i}").over(upto) for i in range(len(values))}).join(F.broadcast(before), "_part")
    return out.select(*df.columns, *[(F.col(f"_run_{i}") + F.col(f"_before_{i}")).alias(n) for i, n in enumerate(values)])


def running_sum(df: DataFrame, value: Column, *order: Column | str, name: str = "running", inclusive: bool = True) -> DataFrame:
    """``df`` with the running sum of ``value`` in the given order (W1, W2; ``inclusive=False``: W3)."""
    out = running_sums(df, {"_total": value}, *order)
    return out.select(*df.columns, (F.col("_total") if inclusive else F.col("_total") - value).alias(name))


def grouped_running_sum(df: DataFrame, value: Column, keys: list[str], *order: Column) -> DataFrame:
    """``df`` with ``_before`` and ``_total``: the sums of ``value`` over the rows of the same keys that come
    earlier in the order, and over all of them.

    Rows are range-partitioned by keys and order, so many tasks share a hot key; what goes by key alone is
    one number for each key and partition.
    """
    rows = _sorted(df.withColumn("_value", value), [*map(F.col, keys), *order])
    sums = rows.groupBy(*keys, "_part").agg(F.sum("_value").alias("_n"))
    ahead = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"), F.sum("_n").over(Window.partitionBy(*keys)).alias("_total"))
    within = Window.partitionBy(*keys, "_part").orderBy("_mono").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("_run", F.coalesce(F.sum("_value").over(within), F.lit(0))).join(sums, [*keys, "_part"])
    return out.select(*df.columns, (F.col("_ahead") + F.col("_run")).alias("_before"), "_total")


def is_sorted(df: DataFrame, place: str, value: str) -> DataFrame:
    """(violations): neighbours by ``place`` whose values go down."""
    rows = _sorted(df.select(place, value), [F.col(place)])
    by = Window.partitionBy("_part").orderBy("_mono")
    inside = rows.withColumn("_prev", F.lag(value).over(by)).agg(F.count_if(F.col(value) < F.col("_prev")).alias("n"))
    ends = rows.groupBy("_part").agg(F.min_by(value, "_mono").alias("first"), F.max_by(value, "_mono").alias("last"))
    across = ends.withColumn("_prev", F.lag("last").over(Window.orderBy("_part"))).agg(F.count_if(F.col("first") < F.col("_prev")).alias("n"))
    return inside.unionByName(across).agg(F.sum("n").cast("long").alias("violations"))


def range_overlaps(dealt: DataFrame, key: str) -> DataFrame:
    """(rows, overlaps, descents) of rows dealt into ranges and sorted inside: neighbouring ranges that
    overlap, and neighbours in a range that go down; both 0 where ``dealt`` is a bucket sort."""
    rows = stored(dealt.select(F.col(key).alias("_k")).withColumn("_part", F.spark_partition_id()).withColumn("_mono", F.monotonically_increasing_id()), "dealt")
    inside = rows.withColumn("_prev", F.lag("_k").over(Window.partitionBy("_part").orderBy("_mono")))
    sums = inside.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("_k") < F.col("_prev")).alias("descents"))
    ends = rows.groupBy("_part").agg(F.min("_k").alias("low"), F.max("_k").alias("high"))  # one row a partition
    over = ends.withColumn("_prev", F.lag("high").over(Window.orderBy("_part"))).agg(F.count_if(F.col("low") <= F.col("_prev")).alias("overlaps"))
    return sums.crossJoin(over).select("rows", "overlaps", "descents")
