"""Sparse matrices and graphs in text and binary formats, as entries (row, col, val) from 0."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.operators.edges import csr_offsets
from weftgraph.sources.records import file_size, read_bytes, records, write_records
from weftgraph.sources.text_files import numbered_lines, tokens, write_lines
from weftgraph.storage import stored

#: Entries of a task that puts rows together as lines, about.
PER_TASK = 1_000_000

# Formats by file extension.
EXTENSIONS = {"csr": "csr", "ijv": "ijv", "cluto": "cluto", "clu": "cluto", "metis": "metis", "graph": "metis", "binrow": "binrow", "bincol": "bincol", "bijv": "bijv"}
FORMATS = tuple(sorted(set(EXTENSIONS.values())))


def determine_format(path: str, fmt: str = "auto") -> str:
    """The format named, or that of the extension; csr if neither says."""
    if fmt != "auto":
        if fmt not in FORMATS:
            raise ValueError(f"format must be auto or one of {FORMATS}")
        return fmt
    return EXTENSIONS.get(path.rstrip("/").rsplit(".", 1)[-1].lower(), "csr")


def format_of(path: Column | str) -> Column:
    """The format of each path of a column, by its extension; csr for others."""
    last = F.lower(F.substring_index(F.rtrim(path, F.lit("/")), ".", -1))
    named = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return F.coalesce(F.try_element_at(named, last), F.lit("csr"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) without comments, so the header is line 0."""
    return numbered_lines(spark, path, ~F.startswith(F.ltrim("value"), F.lit("%")))


def _header(lines: DataFrame) -> list[int]:
    row = lines.where("line = 0").select(tokens("value").alias("t")).first()
    if row is None:
        raise ValueError("the file has no header")
    return [int(x) for x in row["t"]]


def _body(lines: DataFrame) -> DataFrame:
    """(row, t): token lines behind the header, numbered from 0."""
    return lines.where("line > 0").select((F.col("line") - 1).alias("row"), tokens("value").alias("t"))


def _pairs(rows: DataFrame, skip: int, values: bool, base: int) -> DataFrame:
    """Entries of rows of tokens, of which ``skip`` come first; index and value take turns, or indices alone."""
    step = 2 if values else 1
    bad = F.raise_error(F.concat(F.lit("an odd number of tokens in row "), F.col("row").cast("string")))
    n = F.size("t") - skip
    places = F.when(n <= 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(skip), F.size("t") - step, F.lit(step)))
    places = F.when(n % step == 0, places).otherwise(bad.cast("array<int>")) if step == 2 else places
    flat = rows.select("row", "t", F.explode(places).alias("p"))
    value = F.get("t", F.col("p") + 1).cast("double") if values else F.lit(1.0)
    return flat.select("row", (F.get("t", F.col("p")).cast("long") - base).alias("col"), value.alias("val"))


def read_csr(spark: SparkSession, path: str, values: bool | None = True, one_based: bool = False) -> DataFrame:
    """A line is a row; no header (S16, J10 input).

    ``values`` True: pairs of index and value; False: indices, each with the value 1; None: indices, and
    the result has no values: (row, col).
    """
    out = _pairs(numbered_lines(spark, path).select(F.col("line").alias("row"), tokens("value").alias("t")), 0, bool(values), int(one_based))
    return out.drop("val") if values is None else out


def read_cluto(spark: SparkSession, path: str) -> DataFrame:
    """Header ``rows cols entries``, then 1-based pairs a row."""
    lines = _lines(spark, path)
    _header(lines)
    return _pairs(_body(lines), 0, True, 1)


def read_metis(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(entries, vertices) of a METIS file (S6, S15): vertices are (id, size, weights).

    The header is ``vertices edges [fmt [ncon]]``; the digits of fmt tell of vertex sizes, vertex weights and
    edge weights.  Indices are 1-based; entries without a weight have 1.  A wrong number of entries and
    negative sizes or weights raise.
    """
    lines = _lines(spark, path)
    head = _header(lines)
    n, m = head[0], head[1]
    fmt = f"{head[2]:03d}" if len(head) > 2 else "000"
    sizes, weights, valued = (int(c) for c in fmt[-3:])
    ncon = (head[3] if len(head) > 3 else 1) if weights else 0
    rows = _body(lines).where(F.col("row") < n)
    entries = _pairs(rows, sizes + ncon, bool(valued), 1)
    found = entries.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("val") < 0).alias("neg")).first()
    if found["n"] != 2 * m:
        raise ValueError(f"the header tells of {m} edges, the file has {found['n']} ends")
    size = F.get("t", 0).cast("double") if sizes else F.lit(None).cast("double")
    wgts = F.transform(F.slice("t", sizes + 1, ncon), lambda x: x.cast("double")) if ncon else F.lit(None).cast("array<double>")
    vertices = rows.select(F.col("row").alias("id"), size.alias("size"), wgts.alias("weights"))
    if found["neg"] or not vertices.where(F.coalesce(F.col("size") < 0, F.lit(False)) | F.coalesce(F.exists("weights", lambda x: x < 0), F.lit(False))).isEmpty():
        raise ValueError("negative sizes or weights")
    return entries, vertices


def read_ijv(spark: SparkSession, path: str, values: bool = True, one_based: bool = False) -> DataFrame:
    """Lines ``i j [v]``, separated by blanks or tabs."""
    t = spark.read.text(path).where("trim(value) <> ''").select(tokens("value").alias("t"))
    want = 3 if values else 2
    bad = F.raise_error(F.concat(F.lit(f"not {want} tokens: "), F.array_join("t", " ")))
    row = F.when(F.size("t") == want, F.get("t", 0).cast("long")).otherwise(bad.cast("long"))
    base = int(one_based)
    return t.select((row - base).alias("row"), (F.get("t", 1).cast("long") - base).alias("col"), (F.get("t", 2).cast("double") if values else F.lit(1.0)).alias("val"))


def read_bijv(spark: SparkSession, path: str) -> DataFrame:
    """A 20-byte header, then packed (int32, int32[, float32])."""
    _, _, nnz, valued = struct.unpack("<iiQi", read_bytes(path, 0, 20))
    r = records(spark, path, "i4,i4,f4" if valued == 1 else "i4,i4", 20, nnz)
    return r.select(F.col("f0").cast("long").alias("row"), F.col("f1").cast("long").alias("col"), (F.col("f2").cast("double") if valued == 1 else F.lit(1.0)).alias("val"))


def read_binrow(spark: SparkSession, path: str, by_column: bool = False) -> DataFrame:
    """int32 rows and cols, int64 pointers, int32 indices, float32 values if there are any (S10; S11)."""
    rows, cols = struct.unpack("<ii", read_bytes(path, 0, 8))
    n = cols if by_column else rows
    start = 8 + 8 * (n + 1)
    (nnz,) = struct.unpack("<q", read_bytes(path, start - 8, 8))
    valued = file_size(path) >= start + 8 * nnz
    ptr = records(spark, path, "i8", 8, n + 1).select(F.col("idx").alias("major"), F.col("f0").alias("a"))
    ends = ptr.select((F.col("major") - 1).alias("major"), F.col("a").alias("b"))
    runs = ptr.join(ends, "major").where("b > a").select("major", F.explode(F.sequence("a", F.col("b") - 1)).alias("idx"))
    out = runs.join(records(spark, path, "i4", start, nnz).select("idx", F.col("f0").cast("long").alias("minor")), "idx")
    if valued:
        out = out.join(records(spark, path, "f4", start + 4 * nnz, nnz).select("idx", F.col("f0").cast("double").alias("val")), "idx")
    else:
        out = out.withColumn("val", F.lit(1.0))
    a, b = ("minor", "major") if by_column else ("major", "minor")
    return out.select(F.col(a).alias("row"), F.col(b).alias("col"), "val")


def read_matrix(spark: SparkSession, path: str, fmt: str = "auto", values: bool = True, one_based: bool = False) -> DataFrame:
    """Entries of a file of any format."""
    fmt = determine_format(path, fmt)
    return {
        "csr": lambda: read_csr(spark, path, values, one_based),
        "cluto": lambda: read_cluto(spark, path),
        "metis": lambda: read_metis(spark, path)[0],
        "ijv": lambda: read_ijv(spark, path, values, one_based),
        "bijv": lambda: read_bijv(spark, path),
        "binrow": lambda: read_binrow(spark, path),
        "bincol": lambda: read_binrow(spark, path, by_column=True),
    }[fmt]()


def _number(c: str):
    return F.when(F.col(c) == F.floor(c), F.col(c).cast("long").cast("string")).otherwise(F.col(c).cast("string"))


def write_matrix(m: DataFrame, path: str, fmt: str, n_rows: int, n_cols: int, values: bool = True) -> None:
    """Entries to a directory of text part files, or to one binary file.

    METIS needs a square matrix with an even number of entries; CLUTO always has values; both are 1-based.
    """
    fmt = determine_format(path, fmt)
    if fmt == "ijv":
        text = F.concat_ws(" ", "row", "col", F.format_string("%.8f", "val")) if values else F.concat_ws(" ", "row", "col")
        m.select(text.alias("value")).write.text(path)
        return
    if fmt == "bijv":
        head = struct.pack("<iiQi", n_rows, n_cols, m.count(), int(values))
        write_records(m, path, ["row", "col", "val"] if values else ["row", "col"], "i4,i4,f4" if values else "i4,i4", ["row", "col"], head)
        return
    if fmt in ("binrow", "bincol"):
        _write_binary(m, path, fmt, n_rows, n_cols, values)
        return
    m = m.select("row", "col", "val") if hasattr(m, "_weft_path") else stored(m.select("row", "col", "val"), "entries")
    nnz = m.count()
    if fmt == "metis" and (n_rows != n_cols or nnz % 2):
        raise ValueError("METIS files hold square matrices with an even number of entries")
    values, base = values or fmt == "cluto", int(fmt != "csr")
    pair = F.concat_ws(" ", F.col("i") + base, _number("v")) if values else (F.col("i") + base).cast("string")
    # entries are dealt by their number; a list is several times the size of its entries
    n = max(m.sparkSession.sparkContext.defaultParallelism, -(-nnz // PER_TASK))
    lists = m.select("row", F.col("col").alias("i"), F.col("val").alias("v")).select("row", "i", pair.alias("p")).repartition(n, "row").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("i", "p"))).alias("ps"))
    lines = m.sparkSession.range(n_rows).join(lists.withColumnRenamed("row", "id"), "id", "left")
    lines = lines.select(F.col("id").alias("line"), F.coalesce(F.array_join(F.transform("ps", lambda x: x["p"]), " "), F.lit("")).alias("value"))
    if fmt != "csr":
        head = f"{n_rows} {n_cols} {nnz}" if fmt == "cluto" else f"{n_rows} {nnz // 2}" + (" 001" if values else "")
        lines = lines.unionByName(m.sparkSession.range(1).select(F.lit(-1).cast("long").alias("line"), F.lit(head).alias("value")))
    write_lines(lines, path)


def _write_binary(m: DataFrame, path: str, fmt: str, n_rows: int, n_cols: int, values: bool) -> None:
    """Pointers, indices and values follow each other as 4-byte words, so one sorted stream is the file."""
    major, minor, n = ("col", "row", n_cols) if fmt == "bincol" else ("row", "col", n_rows)
    spark = m.sparkSession
    deg = spark.range(n + 1).join(m.groupBy(F.col(major).alias("id")).agg(F.count(F.lit(1)).alias("degree")), "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))
    ptr = csr_offsets(deg)
    word = lambda section, a, b, x: [F.lit(section).alias("s"), F.col(a).cast("long").alias("a"), b.cast("long").alias("b"), x.cast("int").alias("w")]
    low = F.col("begin").bitwiseAND(F.lit(0xFFFFFFFF))
    signed = F.when(low >= 2**31, low - 2**32).otherwise(low)
    words = ptr.select(*word(0, "id", F.lit(0), signed)).unionByName(ptr.select(*word(0, "id", F.lit(1), F.shiftright("begin", 32))))
    words = words.unionByName(m.select(*word(1, major, F.col(minor), F.col(minor)))).withColumn("x", F.lit(0.0))
    if values:
        words = words.unionByName(m.select(F.lit(2).alias("s"), F.col(major).cast("long").alias("a"), F.col(minor).cast("long").alias("b"), F.lit(None).cast("int").alias("w"), F.col("val").cast("double").alias("x")))
    big = m.where((F.col(minor) < 0) | (F.col(minor) > 2**31 - 1))
    if not big.isEmpty():
        raise ValueError("indices don't fit 32 bits")
    # a word of any section is a 32-bit pattern; floats travel as theirs
    words = words.select("s", "a", "b", F.when(F.col("s") == 2, float_bits("x")).otherwise(F.col("w")).alias("word"))
    write_records(words, path, ["word"], "i4", ["s", "a", "b"], struct.pack("<ii", n_rows, n_cols))


@F.pandas_udf(T.IntegerType())
def float_bits(x: pd.Series) -> pd.Series:
    """The bits of 32-bit floats as integers; built-in functions can't reinterpret."""
    return pd.Series(x.fillna(0).to_numpy().astype("<f4").view("<i4"))
