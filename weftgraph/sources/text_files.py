"""Text files: numbered lines, scalars per line, statistics, paths, and small formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.storage import stored

#: Up to so many splits of files, their line counts (one row each, some hundred bytes) are broadcast.
SPLITS = 500_000

#: Fixed value: the residue alphabet of a PSSM file, by index.
RESIDUES = "ARNDCQEGHILKMFPSTWYVBZX*"


def numbered_lines(spark: SparkSession, path: str, keep: Column | None = None) -> DataFrame:
    """(line, value): lines numbered from 0 in the order of file names and places.

    ``keep``: only the lines for which this is true are there and count.  No line is sorted or exchanged:
    the scan's own tasks write the lines down, so that splits stay what they are whatever becomes of
    executors, and the place of a line is its place in its split plus the lines of the splits before.
    Only one row for each split goes through a single task.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"))
    raw = raw if keep is None else raw.where(keep)
    rows = stored(raw.withColumn("_m", F.monotonically_increasing_id()), "lines")
    splits = stored(rows.groupBy("_f", "_b").agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_first")), "splits")
    ahead = Window.orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1)
    before = splits.select("_f", "_b", (F.coalesce(F.sum("_n").over(ahead), F.lit(0)) - F.col("_first")).alias("_shift"))
    before = F.broadcast(before) if splits.count() <= SPLITS else before
    return rows.join(before, ["_f", "_b"]).select((F.col("_m") + F.col("_shift")).alias("line"), "value")


def read_scalars(spark: SparkSession, path: str, kind: str = "bigint") -> DataFrame:
    """(line, value): one number per line."""
    return numbered_lines(spark, path).select("line", F.trim("value").cast(kind).alias("value"))


def tokens(col: Column | str) -> Column:
    """Tokens between runs of blanks and tabs, none empty."""
    return F.filter(F.split(col, r"[ \t\r]+"), lambda x: x != "")


def file_stats(spark: SparkSession, path: str) -> DataFrame:
    """(n_lines, n_tokens, max_tokens, n_bytes).

    A last line without an end counts as a line here; bytes are those of the lines and their ends.
    """
    n = F.size(tokens("value"))
    sums = spark.read.text(path).agg(F.count(F.lit(1)).alias("n_lines"), F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("n_tokens"), F.coalesce(F.max(n), F.lit(0)).cast("long").alias("max_tokens"))
    size = spark.read.format("binaryFile").load(path).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n_bytes"))  # reads no content
    return sums.crossJoin(F.broadcast(size))  # a row each


def write_lines(df: DataFrame, path: str, line: str = "line", value: str = "value") -> None:
    """Lines in order: part files follow each other by name."""
    df.repartitionByRange(line).sortWithinPartitions(line).select(value).write.text(path)


def path_parts(col: Column | str) -> dict[str, Column]:
    """dir, file, base (without the last extension) and ext of a path."""
    c = F.col(col) if isinstance(col, str) else col
    file = F.element_at(F.split(c, "/"), -1)
    has_dir, has_ext = F.instr(c, "/") > 0, F.rlike(file, F.lit(r"\.[^.]*$"))
    return {
        "dir": F.when(has_dir, F.regexp_replace(c, r"/[^/]*$", "")).otherwise(F.lit("")),
        "file": file,
        "base": F.regexp_replace(file, r"\.[^.]*$", ""),
        "ext": F.when(has_ext, F.element_at(F.split(file, r"\."), -1)).otherwise(F.lit("")),
    }


def _hadoop(spark: SparkSession, path: str):
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark._jsc.hadoopConfiguration()), hpath


def _status(spark: SparkSession, path: str):
    fs, p = _hadoop(spark, path)
    return fs.getFileStatus(p) if fs.exists(p) else None


def file_exists(spark: SparkSession, path: str) -> bool:
    """Of any file system that Spark knows, as all of these."""
    found = _status(spark, path)
    return found is not None and found.isFile()


def dir_exists(spark: SparkSession, path: str) -> bool:
    found = _status(spark, path)
    return found is not None and found.isDirectory()


def file_bytes(spark: SparkSession, path: str) -> int:
    """-1 where there is no such file."""
    found = _status(spark, path)
    return found.getLen() if found is not None and found.isFile() else -1


def make_path(spark: SparkSession, path: str) -> bool:
    """A folder and those above it."""
    fs, p = _hadoop(spark, path)
    return fs.mkdirs(p)


def remove_path(spark: SparkSession, path: str) -> bool:
    """A folder or file with all below it; False where there is none."""
    fs, p = _hadoop(spark, path)
    return fs.delete(p, True)


def read_pssm(spark: SparkSession, path: str) -> DataFrame:
    """(pos, residue, code, pssm, psfm): a header line of 20 residues, then index, residue and twice 20
    integers a line (S23); residues in upper case, codes from ``RESIDUES``, -1 for others."""
    rows = numbered_lines(spark, path).where("line > 0 and trim(value) <> ''").select("line", tokens("value").alias("t"))
    bad = F.raise_error(F.concat(F.lit("not 42 tokens in line "), F.col("line")))
    ints = lambda a: F.transform(F.slice("t", a, 20), lambda x: x.cast("int"))
    residue = F.upper(F.get("t", 1))
    return rows.select(
        F.when(F.size("t") == 42, F.get("t", 0).cast("int")).otherwise(bad.cast("int")).alias("pos"), residue.alias("residue"),
        F.expr(f"instr('{RESIDUES}', upper(get(t, 1))) - 1").alias("code"), ints(3).alias("pssm"), ints(23).alias("psfm"),
    )


def read_tensor(spark: SparkSession, path: str) -> DataFrame:
    """(k, i, j, v) of 1-based coordinate lines, as 0-based."""
    t = spark.read.text(path).where("trim(value) <> ''").select(tokens("value").alias("t"))
    return t.select(*[(F.get("t", n).cast("long") - 1).alias(c) for n, c in enumerate("kij")], F.get("t", 3).cast("double").alias("v"))
