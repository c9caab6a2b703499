"""Packed little-endian records in binary files: a Spark data source with byte ranges as partitions.

A file is opened through ``pyarrow.fs``, so URIs of any file system that it knows work; plain paths are
local or mounted.  Trailing bytes that are no whole record are left out.

Where a store can't write into the middle of a file, the bytes are a folder of part files with a manifest that names them
in order; readers take it for one file.  Either way nothing is to be seen of a write before all of its
tasks have succeeded, and what was there before stays until then.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from weftgraph.operators.ordering import with_rank

_SQL = {"i1": "tinyint", "i2": "smallint", "i4": "int", "i8": "bigint", "f4": "float", "f8": "double"}


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


MANIFEST = "_manifest.json"


def _parts(path: str) -> list[tuple[str, int]]:
    """(file, bytes) of what makes up ``path``, in order: the parts of its manifest, or the file itself."""
    fs, p = _fs(path)
    if fs.get_file_info(f"{p}/{MANIFEST}").type == pafs.FileType.File:
        with fs.open_input_stream(f"{p}/{MANIFEST}") as f:
            return [(f"{p}/{name}", n) for name, n in json.loads(f.read())]
    info = fs.get_file_info(p)
    if info.type != pafs.FileType.File:
        raise FileNotFoundError(path)
    return [(p, info.size)]


def read_bytes(path: str, offset: int, n: int, parts: list[tuple[str, int]] | None = None) -> bytes:
    fs, out, start = _fs(path)[0], [], 0
    for name, size in _parts(path) if parts is None else parts:
        a, b = max(offset, start), min(offset + n, start + size)
        if a < b:
            with fs.open_input_file(name) as f:
                out.append(f.read_at(b - a, a - start))
        start += size
    return b"".join(out)


def file_size(path: str) -> int:
    return sum(n for _, n in _parts(path))


class _Range(InputPartition):
    def __init__(self, first: int, n: int):
        self.first, self.n = first, n


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.kinds, self.offset = options["path"], options["kinds"].split(","), int(options.get("offset", 0))
        self.width = sum(np.dtype(k).itemsize for k in self.kinds)
        self.parts = _parts(self.path)
        there = max(0, sum(n for _, n in self.parts) - self.offset) // self.width
        count = int(options.get("count", -1))
        self.n, self.step = there if count < 0 else min(count, there), max(1, int(options.get("range_bytes", 64 << 20)) // self.width)

    def partitions(self) -> list[InputPartition]:
        return [_Range(a, min(self.step, self.n - a)) for a in range(0, self.n, self.step)] or [_Range(0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        kind = np.dtype([(f"f{i}", "<" + k) for i, k in enumerate(self.kinds)])
        at, end = partition.first, partition.first + partition.n
        while at < end:
            n = min(1 << 16, end - at)
            rows = np.frombuffer(read_bytes(self.path, self.offset + at * self.width, n * self.width, self.parts), kind)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(rows))), *(pa.array(np.ascontiguousarray(rows[c])) for c in kind.names)], names=["idx", *kind.names])
            at += n


class PackedRecords(DataSource):
    @classmethod
    def name(cls) -> str:
        return "weft_records"

    def schema(self) -> str:
        return ", ".join(["idx bigint", *(f"f{i} {_SQL[k]}" for i, k in enumerate(self.options["kinds"].split(",")))])

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        """Replaces what is there: columns as records of ``kinds``, behind the bytes that ``head`` spells in hex.

        With ``total`` (rows in all) the last column is a row's place, and the result is one file; without it
        rows keep the order of partitions, in part files.
        """
        if not overwrite:
            raise ValueError("packed records are replaced, not appended to: use mode('overwrite')")
        return (_OneFile if "total" in self.options else _PartFiles)(dict(self.options), schema.names)


@dataclass
class _Done(WriterCommitMessage):
    partition: int
    name: str
    n: int


class _OneFile(DataSourceArrowWriter):
    """Every task writes its rows at their places in a hidden file, which takes the target's name at the end.
    A task that is repeated writes the same bytes again."""

    def __init__(self, options: dict, names: list[str]):
        self.kinds, self.names, self.total = options["kinds"].split(","), names, int(options["total"])
        self.path, self.head = _fs(options["path"])[1], bytes.fromhex(options.get("head", ""))
        self.width = sum(np.dtype(k).itemsize for k in self.kinds)
        folder, name = os.path.split(self.path)
        self.hidden = os.path.join(folder, f".{name}.{uuid.uuid4().hex}")
        with open(self.hidden, "wb") as out:
            out.write(self.head)
            out.truncate(len(self.head) + self.total * self.width)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Done:
        n = 0
        with open(self.hidden, "r+b") as out:
            for batch in iterator:
                at = batch.column(batch.num_columns - 1).to_numpy()
                block = packed(batch, self.names[:-1], self.kinds)
                cuts = [0, *(np.flatnonzero(np.diff(at) != 1) + 1).tolist(), len(at)]
                for a, b in zip(cuts, cuts[1:]):
                    if b > a:
                        out.seek(len(self.head) + int(at[a]) * self.width)
                        out.write(block[a:b].tobytes())
                n += len(at)
        return _Done(0, "", n)

    def commit(self, messages: list[_Done | None]) -> None:
        written = sum(m.n for m in messages if m is not None)
        if written != self.total:
            raise ValueError(f"{written} rows were written where {self.total} were counted")
        os.replace(self.hidden, self.path)

    def abort(self, messages: list[_Done | None]) -> None:
        if os.path.exists(self.hidden):
            os.remove(self.hidden)


class _PartFiles(DataSourceArrowWriter):
    """A part file for each task, under a name of its own; the manifest makes them visible, all at once."""

    def __init__(self, options: dict, names: list[str]):
        self.kinds, self.names, self.path = options["kinds"].split(","), names, options["path"]
        self.head, self.run = bytes.fromhex(options.get("head", "")), uuid.uuid4().hex
        self.rows = int(options.get("rows", -1))
        fs, p = _fs(self.path)
        fs.create_dir(p, recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Done:
        fs, p = _fs(self.path)
        task = TaskContext.get()
        name, n = f"{self.run}-{task.partitionId():06}-{task.taskAttemptId()}", 0
        with fs.open_output_stream(f"{p}/{name}") as out:
            for batch in iterator:
                out.write(packed(batch, self.names, self.kinds).tobytes())
                n += batch.num_rows
        return _Done(task.partitionId(), name, n)

    def commit(self, messages: list[_Done | None]) -> None:
        done = sorted((m for m in messages if m is not None), key=lambda m: m.partition)
        if self.rows >= 0 and sum(m.n for m in done) != self.rows:
            raise ValueError(f"{sum(m.n for m in done)} rows were written where {self.rows} were counted")
        fs, p = _fs(self.path)
        width = sum(np.dtype(k).itemsize for k in self.kinds)
        parts = [(f"{self.run}-head", len(self.head)), *((m.name, m.n * width) for m in done)]
        with fs.open_output_stream(f"{p}/{parts[0][0]}") as out:
            out.write(self.head)
        with fs.open_output_stream(f"{p}/{self.run}.json") as out:
            out.write(json.dumps(parts).encode())
        replaced = set()
        if fs.get_file_info(f"{p}/{MANIFEST}").type == pafs.FileType.File:
            replaced = {name.rsplit("/", 1)[-1] for name, _ in _parts(self.path)}
        fs.move(f"{p}/{self.run}.json", f"{p}/{MANIFEST}")
        named = {name for name, _ in parts}
        self._clear(lambda name: name in replaced or (name.startswith(self.run) and name not in named))

    def abort(self, messages: list[_Done | None]) -> None:
        self._clear(lambda name: name.startswith(self.run))

    def _clear(self, gone) -> None:
        fs, p = _fs(self.path)
        for info in fs.get_file_info(pafs.FileSelector(p, allow_not_found=True)):
            if info.type == pafs.FileType.File and gone(info.base_name):
                fs.delete_file(info.path)


def records(spark: SparkSession, path: str, kinds: str, offset: int = 0, count: int = -1, range_bytes: int = 64 << 20) -> DataFrame:
    """(idx, f0, f1, ...): records of the comma-joined numpy ``kinds`` from ``offset`` on."""
    spark.dataSource.register(PackedRecords)
    reader = spark.read.format("weft_records").option("kinds", kinds).option("offset", offset)
    return reader.option("count", count).option("range_bytes", range_bytes).option("path", path).load()


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst) of a headerless file of int32 pairs."""
    return records(spark, path, "i4,i4").select(F.col("f0").cast("long").alias("src"), F.col("f1").cast("long").alias("dst"))


def read_clean_edges(spark: SparkSession, path: str) -> DataFrame:
    """(u, v) of a file that starts with a 64-bit count of pairs."""
    return read_counted(spark, path, "i4,i4").select(F.col("f0").cast("long").alias("u"), F.col("f1").cast("long").alias("v"))


def read_array(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(idx, value) of a headerless array; its size must be whole."""
    if file_size(path) % np.dtype(kind).itemsize:
        raise ValueError(f"{path} is no array of {kind}")
    return records(spark, path, kind).select("idx", F.col("f0").alias("value"))


def _checked(column: pa.Array, kind: str) -> np.ndarray:
    """The values as ``kind``; raises where an integer doesn't fit, or a value is missing."""
    if column.null_count:
        raise ValueError("a packed record has no place for nulls")
    values = column.to_numpy(zero_copy_only=False)
    if kind[0] == "i" and len(values):
        info = np.iinfo(kind)
        if values.min() < info.min or values.max() > info.max:
            raise ValueError(f"values from {values.min()} to {values.max()} don't fit {kind}")
    return values.astype("<" + kind)


def packed(batch: pa.RecordBatch, names: list[str], kinds: list[str]) -> np.ndarray:
    """Columns of a batch as packed records."""
    block = np.zeros(batch.num_rows, np.dtype([(f"f{i}", "<" + k) for i, k in enumerate(kinds)]))
    for i, (n, k) in enumerate(zip(names, kinds)):
        block[f"f{i}"] = _checked(batch.column(batch.schema.get_field_index(n)), k)
    return block


def write_records(df: DataFrame, path: str, columns: list[str], kinds: str, order: list[str], header: bytes = b"", counted: bool = False, parts: bool | None = None) -> None:
    """Packed records of ``columns`` in ``order``; ``counted`` puts a 64-bit count in front.

    On a mounted file system the result is one file, in which every task writes its rows at their places,
    which a row's rank gives; on other stores, and with ``parts``, it is a folder of part files, one a task.
    What ``path`` held stays until all tasks have succeeded.  Integers that a kind can't hold, and nulls,
    raise; so does a folder of part files in the place of a file.
    """
    names, keys = [f"_w{i}" for i in range(len(columns))], [f"_o{i}" for i in range(len(order))]
    rows = df.select(*[F.col(c).alias(n) for c, n in zip(columns, names)], *[F.col(c).alias(k) for c, k in zip(order, keys)])
    fs, plain = _fs(path)
    parts = not isinstance(fs, pafs.LocalFileSystem) if parts is None else parts
    if parts:
        total = df.count() if counted else -1
        rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select(*names)
        options = {"rows": total}
    else:
        if os.path.isdir(plain):
            raise IsADirectoryError(path)
        rows = with_rank(rows, *keys, name="_at").select(*names, "_at")
        total = rows.count()
        options = {"total": total}
    head = header + (struct.pack("<Q", total) if counted else b"")
    df.sparkSession.dataSource.register(PackedRecords)
    rows.write.format(PackedRecords.name()).options(kinds=kinds, head=head.hex(), path=path, **options).mode("overwrite").save()


def read_counted(spark: SparkSession, path: str, kinds: str) -> DataFrame:
    """(idx, f0, ...) of records behind a 64-bit count of them: arrays, vectors, tuples of any width."""
    (n,) = struct.unpack("<Q", read_bytes(path, 0, 8))
    return records(spark, path, kinds, 8, n)


def write_counted(df: DataFrame, path: str, columns: list[str], kinds: str, order: list[str]) -> None:
    """A 64-bit count, then the packed records in ``order``."""
    write_records(df, path, columns, kinds, order, counted=True)


def write_edges(edges: DataFrame, path: str) -> None:
    write_records(edges, path, ["src", "dst"], "i4,i4", ["src", "dst"])


def write_clean_edges(graph: DataFrame, path: str) -> None:
    write_counted(graph, path, ["u", "v"], "i4,i4", ["u", "v"])


def write_array(df: DataFrame, path: str, kind: str) -> None:
    write_records(df, path, ["value"], kind, ["idx"])
