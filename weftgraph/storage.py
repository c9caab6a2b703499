"""Tables in the folder that driver and executors share.

Lineage is cut with Parquet tables below the folder that ``spark.checkpoint.dir`` names, so a lost
executor never loses an intermediate result.  Only where that setting is absent and the master is a
plain ``local`` one (tests) does this module pick a folder itself.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import DataFrame, SparkSession

_scratch: dict[str, str] = {}
#: Paths handed out and not yet released, in order.
_open: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; raises on a cluster that names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        _scratch[app] = "file://" + tempfile.mkdtemp(prefix="weftgraph-")
    return _scratch[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/weftgraph/{name}-{uuid.uuid4().hex}"
    _open.append(path)
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hpath)
    return path


def width(like: DataFrame, target: int = 128 << 20) -> int:
    """Into how many files a table made from ``like`` should go: a multiple of the cluster's cores with
    about ``target`` bytes of input each, at least one file a core; where Spark doesn't know the size, as
    many as a shuffle has partitions."""
    spark = like.sparkSession
    cores = max(1, spark.sparkContext.defaultParallelism)
    size = int(str(like._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:
        return int(spark.conf.get("spark.sql.shuffle.partitions"))
    return cores * max(1, -(-size // (target * cores)))


def stored(df: DataFrame, name: str, like: DataFrame | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: computed once, lineage cut.

    ``like``: the table that the narrow ``df`` is a scan of.  Rows are made in as many tasks as the scan has,
    then dealt into as many files as their own size asks for, so a scan of a million splits leaves no
    million files.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    with shuffles_dropped(spark):
        (df if like is None else df.hint("rebalance")).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._weft_path = path
    return out


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def shuffles_dropped(spark: SparkSession) -> AbstractContextManager[None]:
    """Inside, a query's shuffle files go as soon as it ends, not when the driver's JVM happens to collect garbage.
    If the same frame is run again, Spark makes them anew."""
    return _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def dealt_by_part(spark: SparkSession) -> AbstractContextManager[None]:
    """Inside, joins whose two sides are dealt alike by some of their keys are planned without another exchange.

    Only for work that is done inside; a frame that is planned later is as right, but exchanges its rows.
    """
    return _setting(spark, "spark.sql.requireAllClusterKeysForCoPartition", "false")


@contextmanager
def released(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """At its end deletes what was stored inside, but for the stored tables that the function it gives was called with.

    Only for work that is done at the end: a result that still reads a deleted table is lost.
    """
    before, kept = len(_open), set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._weft_path)
        return df

    yield keep
    for path in [p for p in _open[before:] if p not in kept]:
        _delete(spark, path)
        _open.remove(path)


def _delete(spark: SparkSession, path: str) -> None:
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hpath, True)


def discard(df: DataFrame) -> None:
    """Delete the files behind a ``stored`` table that nothing will read again."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, path)
