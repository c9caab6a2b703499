"""Vector code compression by product quantization with exact metric search (operator 12).

Vectors become integers, are cut into parts, and each part position learns a small codebook in a fixed
number of Lloyd rounds.  A part's nearest entry is found in a vantage-point tree over the entries of its
position: branch and bound by the triangle inequality.  Radii and bounds are floating-point numbers that
are rounded away from pruning, subtrees at exactly the bound are visited, and what decides is always the
integer squared distance, ties to the lower index; so the result is that of a full search.

A round is one scan: a task adds up the integer sums of its own parts, some numbers for each entry, and
these are summed over tasks.  Only codebooks, ``entries`` rows of a vector's length, reach the driver.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import only, stored

#: Subtrees of so many entries are compared one by one.
LEAF = 6
#: By so much bounds are moved away from pruning; far above the error of a square root or a conversion.
SLACK = 1e-12


@dataclass
class Node:
    """A vantage entry with its two subtrees, or a leaf of ``entries``; a child's ``low`` and ``high`` enclose its
    entries' distances from the vantage entry."""

    entries: np.ndarray
    vantage: int = -1
    children: tuple[tuple[Node, float, float], ...] = ()
    middle: float = 0.0


def build(book: np.ndarray, entries: np.ndarray | None = None) -> Node:
    """The tree over the rows of ``book`` (integers)."""
    entries = np.arange(len(book)) if entries is None else entries
    if len(entries) <= LEAF:
        return Node(entries)
    vantage = int(entries[np.argmax(((book[entries] - book[entries].mean(axis=0)) ** 2).sum(axis=1))])  # a far one parts the others best
    rest = entries[entries != vantage]
    squared = ((book[rest] - book[vantage]) ** 2).sum(axis=1)
    inside = squared <= np.sort(squared)[(len(rest) - 1) // 2]
    children = []
    for side in (rest[inside], rest[~inside]):
        if len(side):
            own = np.sqrt(squared[np.isin(rest, side)].astype(np.float64))
            children.append((build(book, side), float(own.min()) * (1 - SLACK), float(own.max()) * (1 + SLACK)))
    return Node(np.zeros(0, np.int64), vantage, tuple(children), children[0][2])


class Search:
    """Nearest entries of many queries at once: all that go on to a node are looked at together."""

    def __init__(self, book: np.ndarray):
        self.book = book
        self.root = build(book)

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) for each row of ``queries`` (integers)."""
        self.q = queries
        self.best = np.full(len(queries), np.iinfo(np.int64).max)
        self.entry = np.full(len(queries), len(self.book), np.int64)
        self._visit(self.root, np.arange(len(queries)))
        return self.entry, self.best

    def _meet(self, entry: int, rows: np.ndarray) -> np.ndarray:
        squared = ((self.q[rows] - self.book[entry]) ** 2).sum(axis=1)
        best = self.best[rows]
        better = rows[(squared < best) | ((squared == best) & (entry < self.entry[rows]))]
        self.entry[better] = entry
        self.best[rows] = np.minimum(best, squared)
        return squared

    def _visit(self, node: Node, rows: np.ndarray) -> None:
        if not len(rows):
            return
        for entry in node.entries.tolist():
            self._meet(entry, rows)
        if node.vantage < 0:
            return
        away = np.sqrt(self._meet(node.vantage, rows).astype(np.float64))
        inner = away <= node.middle
        # each query takes the side that it lies on first
        for nearer in (True, False):
            for i, (child, low, high) in enumerate(node.children):
                go = inner == ((i == 0) == nearer)
                mine, d = rows[go], away[go]
                bound = np.maximum(d * (1 - SLACK) - high, low - d * (1 + SLACK))
                self._visit(child, mine[bound <= np.sqrt(self.best[mine].astype(np.float64)) * (1 + SLACK)])


@dataclass
class Codebooks:
    """Integer entries by part position, (parts, entries, width)."""

    entries: np.ndarray

    def digest(self) -> str:
        """Lowercase hex SHA-256 of all components by part, entry and position, as decimal numbers with commas."""
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


def _integers(column: pa.Array, d: int, scale: int) -> np.ndarray:
    """(rows, d) of floor(scale * x); raises where squared distances would not fit 64 bits."""
    x = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    if len(x) and np.abs(x).max() > math.isqrt((1 << 62) // d) // 2:
        raise ValueError("a component is too large for squared distances of 64 bits")
    return x.astype(np.int64).reshape(-1, d)


def usable(vectors: DataFrame, vector_col: str, parts: int) -> DataFrame:
    """Rows whose vector has finite components only, a positive multiple of ``parts`` of them."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))  # NaN is above infinity
    return vectors.where(v.isNotNull() & finite & (F.size(v) > 0) & (F.size(v) % parts == 0))


def first_codebooks(rows: DataFrame, id_col: str, vector_col: str, parts: int, entries: int, scale: int) -> Codebooks | None:
    """The parts of the ``entries`` smallest ids, ascending; None without rows."""
    order = [F.asc_nulls_last(id_col), F.col(vector_col)]
    head = rows.orderBy(*order).limit(1).select(F.size(vector_col)).first()
    if head is None:
        return None
    d = head[0]
    got = rows.where(F.size(vector_col) == d).orderBy(*order).limit(entries).select(vector_col).collect()  # `entries` rows
    whole = _integers(pa.array([r[0] for r in got], pa.list_(pa.float64())), d, scale)
    return Codebooks(np.ascontiguousarray(whole.reshape(len(got), parts, d // parts).transpose(1, 0, 2)))


def _assign(books: Codebooks, searches: list[Search], column: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(integers (rows, parts, width), entries (rows, parts), squared distances (rows, parts))."""
    parts, _, width = books.entries.shape
    x = _integers(column, parts * width, scale).reshape(-1, parts, width)
    entry, error = np.zeros(x.shape[:2], np.int64), np.zeros(x.shape[:2], np.int64)
    for p, search in enumerate(searches):
        entry[:, p], error[:, p] = search.nearest(np.ascontiguousarray(x[:, p]))
    return x, entry, error


def refine(rows: DataFrame, vector_col: str, books: Codebooks, scale: int) -> Codebooks:
    """One Lloyd round: entries become the floors of their parts' means; unused ones stay."""
    shipped = rows.sparkSession.sparkContext.broadcast(books.entries)
    parts, k, width = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Codebooks(shipped.value)
        searches = [Search(b) for b in own.entries]
        sums, counts = np.zeros((parts * k, width), np.int64), np.zeros(parts * k, np.int64)
        for batch in batches:
            x, entry, _ = _assign(own, searches, batch.column(0), scale)
            slot = (entry + np.arange(parts) * k).reshape(-1)
            np.add.at(sums, slot, x.reshape(-1, width))
            counts += np.bincount(slot, minlength=parts * k)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(used, width)), pa.array(np.tile(np.arange(width), len(used))), pa.array(sums[used].reshape(-1)), pa.array(np.repeat(counts[used], width))], names=["slot", "at", "total", "n"])

    found = rows.select(vector_col).mapInArrow(run, "slot bigint, at bigint, total bigint, n bigint").groupBy("slot", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    out = books.entries.copy().reshape(parts * k, width)
    for r in found.collect():  # a number for each component of the codebooks
        out[r["slot"], r["at"]] = r["total"] // r["n"]
    return Codebooks(out.reshape(parts, k, width))


def train(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> Codebooks | None:
    """The codebooks after ``rounds`` rounds; None where no row is usable."""
    rows = usable(only(vectors, id_col, vector_col), vector_col, parts)
    books = first_codebooks(rows, id_col, vector_col, parts, entries, scale)
    for _ in range(rounds if books is not None else 0):
        d = books.entries.shape[0] * books.entries.shape[2]
        books = refine(rows.where(F.size(vector_col) == d), vector_col, books, scale)
    return books


def encode(vectors: DataFrame, books: Codebooks, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256) -> DataFrame:
    """(id, label, code, error) of the usable rows of the codebooks' length: one scan."""
    parts, _, width = books.entries.shape
    rows = usable(only(vectors, id_col, vector_col, label_col), vector_col, parts).where(F.size(vector_col) == parts * width).select(id_col, label_col, vector_col)
    kinds = dict(rows.dtypes)
    shipped = vectors.sparkSession.sparkContext.broadcast(books.entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Codebooks(shipped.value)
        searches = [Search(b) for b in own.entries]
        for batch in batches:
            _, entry, error = _assign(own, searches, batch.column(2), scale)
            codes = [row.tobytes().hex() for row in entry.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.string()), pa.array(error.sum(axis=1), pa.int64())], names=[id_col, label_col, "code", "error"])

    return rows.mapInArrow(run, f"`{id_col}` {kinds[id_col]}, `{label_col}` {kinds[label_col]}, code string, error bigint")


def vector_codes(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256
) -> DataFrame:
    """One row per kept row of ``vectors``: id, code, error, label_error, codebooks_sha256.

    Rows whose vector is null or empty, or has null or non-finite components, are dropped, and so are those
    whose length isn't a multiple of ``parts`` or isn't that of the kept row with the smallest id.  Null ids
    come last among the first entries; rows that share an id are rows of their own, the lesser vector
    first.  Fewer than ``entries`` rows make smaller codebooks; up to 256 entries fit a code.  A finite
    component whose squared distances don't fit 64 bits (beyond 2**19 at 64 components and the default
    scale) raises.  An empty table gives an empty result.  Other columns are ignored, whatever their names.
    label_error sums over equal labels, null labels together.
    """
    if not 0 < entries <= 256:
        raise ValueError("entries is 1 to 256")
    books = train(vectors, id_col, vector_col, parts, entries, rounds, scale)
    if books is None:
        none = only(vectors, id_col, vector_col).limit(0)
        return none.select(id_col, *[F.lit(None).cast(t).alias(c) for c, t in (("code", "string"), ("error", "long"), ("label_error", "long"), ("codebooks_sha256", "string"))])
    coded = stored(encode(vectors, books, id_col, vector_col, label_col, scale), "codes")
    sums = stored(coded.groupBy(F.col(label_col).alias("_weft_label")).agg(F.sum("error").alias("label_error")), "label-errors")
    met = coded.join(sums, coded[label_col].eqNullSafe(sums["_weft_label"]))
    return met.select(id_col, "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def vector_sql(parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> str:
    """The same rows in DuckDB's SQL, by a full search."""
    steps = f"""
WITH k AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, embedding FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(embedding) % {parts} = 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT r, i // w AS part, i % w AS pos, floor({scale} * embedding[i + 1]::DOUBLE)::BIGINT AS x FROM
      (SELECT r, embedding, len(embedding) // {parts} AS w, unnest(range(len(embedding))) AS i FROM k)),
c0 AS (SELECT r - 1 AS e, part, pos, x AS y FROM p WHERE r <= {entries}),"""
    for i in range(rounds + 1):
        steps += f"""
a{i} AS (SELECT r, part, min(({{'d': d, 'e': e}})) AS m FROM (SELECT r, part, e, sum((x - y) * (x - y))::BIGINT AS d FROM p JOIN c{i} USING (part, pos) GROUP BY 1, 2, 3) GROUP BY 1, 2),"""
        if i < rounds:
            steps += f"""
s{i} AS (SELECT m.e AS e, part, pos, sum(x)::BIGINT AS s, count(*) AS n FROM a{i} JOIN p USING (r, part) GROUP BY 1, 2, 3),
c{i + 1} AS (SELECT c.e, c.part, c.pos, coalesce((s - ((s % n) + n) % n) // n, y) AS y FROM c{i} c LEFT JOIN s{i} s ON s.e = c.e AND s.part = c.part AND s.pos = c.pos),"""
    return f"""{steps}
h AS (SELECT sha256(string_agg(y::VARCHAR, ',' ORDER BY part, e, pos)) AS codebooks_sha256 FROM c{rounds}),
v AS (SELECT r, string_agg(lower(printf('%02x', m.e)), '' ORDER BY part) AS code, sum(m.d)::BIGINT AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM k JOIN v USING (r) CROSS JOIN h
"""
