"""An extension: a growing edge list kept clean, with its degrees and triangle total, by Structured Streaming.

Each micro-batch brings edges (src, dst).  State is Parquet below one folder, written per batch and
replaced whole, so a batch that runs twice gives the same state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators.edges import clean, degrees


def distinct_stream(stream: DataFrame, time_col: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Clean edges of a stream without repeats; with ``time_col`` only repeats within ``delay`` are known."""
    rows = stream.where(F.col("src").isNotNull() & F.col("dst").isNotNull()).withColumns({"u": F.least("src", "dst"), "v": F.greatest("src", "dst")}).where("u <> v")
    if time_col is None:
        return rows.select("u", "v").dropDuplicates(["u", "v"])
    return rows.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["u", "v"]).select("u", "v", time_col)


class GraphState:
    """Edges (u, v) by batch and the running number of triangles."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str, schema: str, before: int) -> DataFrame:
        """What batches below ``before`` have written."""
        empty = self.spark.createDataFrame([], schema)
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not root.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(root):
            return empty
        return self.spark.read.schema(f"{schema}, batch bigint").parquet(f"{self.path}/{name}").where(F.col("batch") < before).drop("batch")

    def update(self, batch: DataFrame, batch_id: int) -> None:
        """For ``foreachBatch``: new edges, and the triangles that have one of them at least.

        A triangle is counted at its number of new edges: those of old and new edges together less those
        of old ones, found from the new edges on.
        """
        old = self._read("edges", "u bigint, v bigint", batch_id)
        new = clean(batch).join(old, ["u", "v"], "left_anti")
        new.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{self.path}/edges/batch={batch_id}")
        new = self.spark.read.schema("u bigint, v bigint").parquet(f"{self.path}/edges/batch={batch_id}")
        every = old.withColumn("new", F.lit(0)).unionByName(new.withColumn("new", F.lit(1)))
        both = every.select(F.col("u").alias("a"), F.col("v").alias("b"), "new").unionByName(every.select(F.col("v").alias("a"), F.col("u").alias("b"), "new"))
        first = both.select(F.col("a").alias("u"), F.col("b").alias("x"), F.col("new").alias("n1"))
        second = both.select(F.col("a").alias("v"), F.col("b").alias("x"), F.col("new").alias("n2"))
        # from the end of fewer neighbours, so a hub's list is walked only for edges between hubs
        deg = both.groupBy("a").agg(F.count(F.lit(1)).alias("d"))
        ends = new.join(deg.toDF("u", "du"), "u").join(deg.toDF("v", "dv"), "v")
        low = F.struct("du", "u") < F.struct("dv", "v")
        ends = ends.select(F.when(low, F.col("u")).otherwise(F.col("v")).alias("u"), F.when(low, F.col("v")).otherwise(F.col("u")).alias("v"))
        met = ends.join(first, "u").join(second, ["v", "x"])
        # seen once from each of its new edges
        found = met.agg(F.coalesce(F.sum(F.lit(1.0) / (1 + F.col("n1") + F.col("n2"))), F.lit(0.0)).alias("t"))
        found.select(F.round("t").cast("long").alias("triangles"), F.lit(batch_id).cast("long").alias("batch")).write.mode("overwrite").parquet(f"{self.path}/triangles/batch={batch_id}")

    def edges(self) -> DataFrame:
        return self._read("edges", "u bigint, v bigint", 1 << 62)

    def degrees(self) -> DataFrame:
        return degrees(self.edges())

    def triangles(self) -> DataFrame:
        return self._read("triangles", "triangles bigint", 1 << 62).agg(F.coalesce(F.sum("triangles"), F.lit(0)).alias("triangles"))
