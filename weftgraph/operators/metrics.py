"""Metrics of ranked lists (score, label), label above 0: positive; larger scores first.

Ties of the score form one step (A20).  Lists are aggregated to one row per score before any order is
made, and running sums come from ``ordering.running_sum``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.ordering import running_sum, running_sums


def _positive():
    return (F.col("label") > 0).cast("long")


def accuracy(ranked: DataFrame, key: str = "key") -> DataFrame:
    """(accuracy): the best of 100 (TP + N - FP) / (P + N) over cut-offs behind each row.

    Rows are told apart and tied scores ordered by ``key``.
    """
    totals = ranked.agg(F.sum(_positive()).alias("p"), F.sum(1 - _positive()).alias("n"))
    run = running_sum(ranked, 2 * _positive() - 1, F.col("score").desc(), key, name="_gain")
    best = run.agg(F.max("_gain").alias("g"))
    return best.crossJoin(F.broadcast(totals)).select((100.0 * (F.col("g") + F.col("n")) / (F.col("p") + F.col("n"))).alias("accuracy"))


def roc_n(ranked: DataFrame, max_n: int | None = None, compat: bool = False) -> DataFrame:
    """(roc): area under TP against FP up to ``max_n`` false positives, over P * FP; 0 if that is 0.

    A step of tied scores is a trapezoid; ``compat`` halves its area with the integer division.  The step
    that passes max_n ends the area.
    """
    steps = ranked.groupBy("score").agg(F.sum(_positive()).alias("tp"), F.sum(1 - _positive()).alias("fp"))
    run = running_sums(steps, {"_t": F.col("tp"), "_f": F.col("fp")}, F.col("score").desc())
    run = run if max_n is None else run.where(F.col("_f") - F.col("fp") < max_n)
    twice = F.col("fp") * (2 * F.col("_t") - F.col("tp"))
    area = F.sum(F.expr("(fp * (2 * _t - tp)) div 2")) if compat else F.sum(twice / 2)
    totals = run.agg(area.alias("a"), F.max("_t").alias("t"), F.max("_f").alias("f"))
    whole = ranked.agg(F.sum(_positive()).alias("p"))
    return totals.crossJoin(F.broadcast(whole)).select(F.when(F.col("t") * F.col("f") == 0, F.lit(0.0)).otherwise(F.col("a") / (F.col("p") * F.col("f"))).alias("roc"))


def median_rfp(ranked: DataFrame, key: str = "key") -> DataFrame:
    """(rfp): the rate of false positives where half of the positives, rounded up, have been seen."""
    totals = ranked.agg(F.sum(_positive()).alias("p"), F.sum(1 - _positive()).alias("n"))
    run = running_sums(ranked, {"_t": _positive(), "_f": 1 - _positive()}, F.col("score").desc(), key)
    half = run.crossJoin(F.broadcast(totals)).where(F.col("_t") >= F.floor((F.col("p") + 1) / 2))
    return half.agg((F.min("_f") / F.max("n")).alias("rfp"))


def mean_std(df: DataFrame, value: str) -> DataFrame:
    """(mean, std): mean and population deviation."""
    return df.agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
