"""A graph as a packed, bucketed table: neighbour lists as gaps of variable length, ready for joins.

Vertices lie in blocks of neighbouring ids.  A row holds some of a block's vertices with their sorted
neighbours; the table is bucketed by block and part, so what is computed round after round over all edges
moves values of vertices, and never an edge.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.storage import discard, new_path, stored

#: A block is 2^SHIFT neighbouring ids.
SHIFT = 10
#: Blocks with more edges are dealt into parts of about as many.
PART_EDGES = 1 << 20
#: A row holds at most as many edges.
ROW_EDGES = 8192


@dataclass(frozen=True)
class PackedGraph:
    """``table``: (block, part, vertices, neighbours), bucketed; ``shape``: (block, parts), a row a block."""

    spark: SparkSession
    name: str
    shape: DataFrame

    @property
    def table(self) -> DataFrame:
        return self.spark.table(self.name)


def varints(values: np.ndarray) -> bytes:
    """Unsigned 64-bit numbers as bytes of seven bits, lowest first, all but a number's last with the top bit."""
    size = np.ones(len(values), np.int64)
    for k in range(1, 10):
        size += values >= np.uint64(1 << (7 * k))
    begin = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        more = size > k
        low = (values[more] >> np.uint64(7 * k)).astype(np.uint8) & np.uint8(127)
        out[begin[more] + k] = low | np.where(size[more] > k + 1, 128, 0).astype(np.uint8)
    return out.tobytes()


def numbers(packed: bytes) -> np.ndarray:
    """What ``varints`` has packed."""
    data = np.frombuffer(packed, np.uint8)
    end = np.flatnonzero(data < 128)
    begin = np.concatenate([[0], end[:-1] + 1]).astype(np.int64) if len(end) else end
    size = end - begin + 1
    out = np.zeros(len(end), np.uint64)
    for k in range(int(size.max(initial=0))):
        more = size > k
        out[more] |= (data[begin[more] + k] & 127).astype(np.uint64) << np.uint64(7 * k)
    return out


def pack_lists(block: int, src: np.ndarray, dst: np.ndarray) -> tuple[bytes, bytes]:
    """(vertices, neighbours) of the edges of one block, sorted and distinct.

    vertices: gap to the vertex before (the first: to the block's begin) and degree of each.  neighbours: of
    each vertex the zigzag difference of its first neighbour to itself, then gaps less one.  Differences
    are modulo 2^64, so all longs will do.
    """
    first = np.concatenate([[True], src[1:] != src[:-1]])
    at = np.flatnonzero(first)
    degree = np.diff(np.append(at, len(src)))
    heads = src[at]
    gaps = np.diff(heads, prepend=np.int64(block << SHIFT))
    values = np.empty(len(dst), np.uint64)
    values[1:] = dst.view(np.uint64)[1:] - dst.view(np.uint64)[:-1] - np.uint64(1)
    apart = (dst.view(np.uint64)[at] - heads.view(np.uint64)).view(np.int64)
    values[at] = ((apart << np.int64(1)) ^ (apart >> np.int64(63))).view(np.uint64)
    return varints(np.column_stack([gaps, degree]).astype(np.uint64).ravel()), varints(values)


def heads_of(block: int, vertices: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(ids, degrees) of packed vertices."""
    pairs = numbers(vertices).astype(np.int64).reshape(-1, 2)
    return np.int64(block << SHIFT) + np.cumsum(pairs[:, 0]), pairs[:, 1]


def ends_of(heads: np.ndarray, degree: np.ndarray, neighbours: bytes) -> np.ndarray:
    """The neighbours of all ``heads``, one list behind the other."""
    values = numbers(neighbours)
    at = np.cumsum(degree) - degree
    zigzag = values[at]
    begin = ((zigzag >> np.uint64(1)) ^ (np.uint64(0) - (zigzag & np.uint64(1)))) + heads.view(np.uint64)
    steps = values + np.uint64(1)
    steps[at] = begin
    total = np.cumsum(steps, dtype=np.uint64)
    return (total - np.repeat(total[at] - begin, degree)).view(np.int64)


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        block, part, src, dst = (c.to_numpy() for c in batch.columns)
        new = np.flatnonzero((block[1:] != block[:-1]) | (part[1:] != part[:-1])) + 1
        cuts = sorted({0, len(src), *new.tolist(), *range(0, len(src), ROW_EDGES)})
        rows = [(int(block[a]), int(part[a]), *pack_lists(int(block[a]), src[a:b], dst[a:b])) for a, b in zip(cuts, cuts[1:])]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=["block", "part", "vertices", "neighbours"])


def pack_graph(edges: DataFrame, name: str | None = None, buckets: int | None = None, part_edges: int = PART_EDGES) -> PackedGraph:
    """Write edges (src, dst) as a packed table.

    Null ends are dropped and repeats are one edge; loops, and both directions where they are meant, stay.
    The table is ``name`` in the session's catalog (left out: one that goes with the driver's JVM), in as
    many ``buckets`` as a shuffle has partitions unless told otherwise.  A block of more than ``part_edges``
    edges is dealt by hash of the end into parts, each a place of its own in the buckets, so a hub is many
    tasks' work.  An empty graph is an empty table.
    """
    spark = edges.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    pairs = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).where("src is not null and dst is not null")
    pairs = stored(pairs.distinct().withColumn("block", F.shiftright("src", SHIFT)), "pairs")
    parts = F.ceil(F.count(F.lit(1)) / F.lit(part_edges)).cast("int")
    shape = stored(pairs.groupBy("block").agg(parts.alias("parts")), "shape")
    dealt = pairs.join(shape, "block").select("block", F.pmod(F.xxhash64("dst"), F.col("parts")).cast("int").alias("part"), "src", "dst")
    rows = dealt.repartition(buckets, "block", "part").sortWithinPartitions("block", "part", "src", "dst")
    writer = rows.mapInArrow(_encode, "block bigint, part int, vertices binary, neighbours binary").write.format("parquet").option("compression", "zstd")
    if name is None:
        name = f"weft_packed_{uuid.uuid4().hex}"
        writer = writer.option("path", new_path(spark, "packed"))
    writer.bucketBy(buckets, "block", "part").saveAsTable(name)
    discard(pairs)
    return PackedGraph(spark, name, shape)


def open_packed(spark: SparkSession, name: str) -> PackedGraph:
    """A packed table that ``pack_graph`` has written under a name; its shape is read from two columns."""
    shape = spark.table(name).groupBy("block").agg((F.max("part") + 1).alias("parts"))
    return PackedGraph(spark, name, stored(shape, "shape"))


def unpack(graph: PackedGraph) -> DataFrame:
    """(src, dst) of a packed graph, without an exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, vertices, neighbours in zip(*(c.to_pylist() for c in batch.columns)):
                heads, degree = heads_of(block, vertices)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(heads, degree)), pa.array(ends_of(heads, degree, neighbours))], names=["src", "dst"])

    return graph.table.select("block", "vertices", "neighbours").mapInArrow(run, "src bigint, dst bigint")


def out_degrees(graph: PackedGraph) -> DataFrame:
    """(id, degree) of vertices with edges; neighbours aren't read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, vertices in zip(*(c.to_pylist() for c in batch.columns)):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in heads_of(block, vertices)], names=["id", "degree"])

    return graph.table.select("block", "vertices").mapInArrow(run, "id bigint, degree bigint").groupBy("id").agg(F.sum("degree").alias("degree"))


def _added(ends: list[np.ndarray], shares: list[np.ndarray]) -> pa.RecordBatch:
    """(id, x): the sum of shares at each end; where ends lie close together they aren't sorted for it."""
    end, share = np.concatenate(ends), np.concatenate(shares)
    low, high = int(end.min()), int(end.max())
    if high - low < 4 * len(end):
        place = end - low
        sums, met = np.bincount(place, share), np.zeros(high - low + 1, bool)
        met[place] = True
        at = np.flatnonzero(met)
        return pa.RecordBatch.from_arrays([pa.array(at + low), pa.array(sums[at])], names=["id", "x"])
    at, place = np.unique(end, return_inverse=True)
    return pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.bincount(place, share, len(at)))], names=["id", "x"])


def _flows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each vertex's share adds up to at the ends of its edges, summed for the rows of a block that lie together."""
    ends, shares, held, last = [], [], 0, None
    for batch in batches:
        block, vertices, neighbours = (c.to_pylist() for c in batch.columns[:3])
        for i, (b, v, n) in enumerate(zip(block, vertices, neighbours)):
            if held and (b != last or held >= PART_EDGES):
                yield _added(ends, shares)
                ends, shares, held = [], [], 0
            heads, degree = heads_of(b, v)
            dense = np.zeros(1 << SHIFT)
            dense[batch.column(3)[i].values.to_numpy() - (b << SHIFT)] = batch.column(4)[i].values.to_numpy()
            end = ends_of(heads, degree, n)
            if len(end):
                ends.append(end)
                shares.append(np.repeat(dense[heads - (b << SHIFT)], degree))
            held, last = held + len(end), b
    if held:
        yield _added(ends, shares)


def edge_sums(graph: PackedGraph, shares: DataFrame) -> DataFrame:
    """(id, x): for each vertex the sum of ``shares`` (id, x; an id once) over the edges that lead to it.

    Shares go to the buckets of the table as one row a block and part, at most 2^SHIFT numbers wide; the
    table itself stays where it is.
    """
    rows = shares.groupBy(F.shiftright("id", SHIFT).alias("block")).agg(F.collect_list(F.struct("id", "x")).alias("_s"))
    rows = rows.join(graph.shape, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("_s.id").alias("ids"), F.col("_s.x").alias("shares"))
    met = graph.table.join(rows.hint("shuffle_merge"), ["block", "part"]).select("block", "vertices", "neighbours", "ids", "shares")
    return met.mapInArrow(_flows, "id bigint, x double").groupBy("id").agg(F.sum("x").alias("x"))


def pagerank(graph: PackedGraph, follow: float = 0.85, rounds: int = 10) -> DataFrame:
    """(id, pr) after ``rounds`` rounds from equal values, edges of equal weight; what vertices without edges
    hold goes to all (G9).  As ``graph.pagerank`` with ``fixed``, but no round moves or reads a wider edge."""
    out = out_degrees(graph)
    ends = edge_sums(graph, out.select("id", F.lit(0.0).alias("x"))).select("id", F.lit(0).cast("long").alias("degree"))
    vertices = stored(out.unionByName(ends).groupBy("id").agg(F.sum("degree").alias("degree")), "vertices")
    n, sinks = vertices.agg(F.count(F.lit(1)), F.count_if(F.col("degree") == 0)).first()
    now = vertices.withColumn("pr", F.lit(1.0 / n if n else 0.0))
    for i in range(rounds):
        flow = edge_sums(graph, now.where("degree > 0").select("id", (F.col("pr") / F.col("degree")).alias("x")))
        lost = now.where("degree = 0").agg(F.coalesce(F.sum("pr"), F.lit(0.0))).first()[0] if sinks else 0.0
        nxt = vertices.join(flow, "id", "left").select("id", "degree", (follow * (F.coalesce("x", F.lit(0.0)) + lost / n) + (1 - follow) / n).alias("pr")) if n else now
        nxt = stored(nxt, "pagerank")
        if i:
            discard(now)
        now = nxt
    return now.select("id", "pr")
