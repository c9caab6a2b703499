"""What the operators of this subpackage share: null rules, text rules, column checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.session import reach
from weftgraph.storage import discard, new_path, shared_dir, stored, width  # noqa: F401

#: ASCII white space of every text contract here, as a Java/RE2 character class.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def text_of(col: str | Column) -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def normalise_space(col: Column) -> Column:
    """Each run of ASCII white space becomes one space."""
    return F.regexp_replace(col, SPACE, " ")


def only(df: DataFrame, *cols: str) -> DataFrame:
    """Project to the named columns, so that a caller's extra columns can't clash with an operator's own."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; have {df.columns}")
    return df.select(*cols)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Bytes of an Arrow batch at most, but for a single longer text.
BATCH = 2 << 20


def ready(spark: SparkSession) -> SparkSession:
    """The session, with workers that can import the package and Arrow batches bounded by bytes.

    Rows are whole texts here; a batch is held by the JVM and by a Python worker at once.  The bound is a
    setting of the session; a smaller one of the caller's stays.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if not 0 < now <= BATCH:
        spark.conf.set(key, str(BATCH))
    return reach(spark)
