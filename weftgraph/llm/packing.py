"""Best-fit packing of documents into token sequences (operator 7).

Executors tokenise whole texts and keep a narrow row for each piece.  How many pieces have each length,
at most ``capacity`` numbers, is all that the driver sees; ``binpack`` makes of it a plan of a few
thousand rows that says which length goes where.  Pieces then find their place by their rank within
their length.  Ranks come from a hash bucket's running number plus the sizes of the buckets before it,
so a length that a third of all pieces share is dealt over all tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.binpack import best_plan, slots
from weftgraph.llm.common import only, stored, text_of
from weftgraph.llm.tokenizer import encoder_of, read_parts

#: Hash buckets within a length.
BUCKETS = 4096


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Rows (id, piece, start, length, ids_crc32[, ids]): each document's ids and ``end_id``, cut from behind.

    Only documents of more than ``capacity`` ids are cut; all their pieces but the first are full.
    """
    parts = docs.sparkSession.sparkContext.broadcast(read_parts(tokenizer_path))  # a vocabulary file has a fixed size
    own = only(docs, id_col, text_col).select(F.col(id_col), text_of(text_col).alias("_text"))
    kind = own.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(parts.value)
        for batch in batches:
            where, piece, start, length, crc, kept = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                ids = np.append(encoder.ids(text.as_py()), np.array([end_id], "<u4"))
                cuts = [*range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip([0, *cuts], cuts)):
                    part = ids[a:b]
                    where.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(part.tobytes()))
                    if with_ids:
                        kept.append(part.astype(np.int32))
            columns = [batch.column(0).take(pa.array(where, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            names = [id_col, "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    more = ", ids array<int>" if with_ids else ""
    return own.mapInArrow(run, f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint{more}")


def place(pieces: DataFrame, keys: list[str], capacity: int, buckets: int = BUCKETS) -> DataFrame:
    """``pieces`` with sequence_id and offset.  It is read twice, so hand in a stored table.

    ``keys`` tell pieces apart; ``length`` is 1 to ``capacity``.  Equal keys share a bucket and are
    still placed apart.
    """
    spark = pieces.sparkSession
    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    sizes = dealt.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "_bucket", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    plan = spark.sparkContext.broadcast(slots(best_plan(counts, capacity)[0], capacity))
    within = Window.partitionBy("length", "_bucket").orderBy(*keys)
    ranked = dealt.withColumn("_rank", F.row_number().over(within) - 1).join(offsets, ["length", "_bucket"])
    ranked = ranked.select(*pieces.columns, (F.col("_rank") + F.col("_before")).alias("_rank"))
    own = list(pieces.columns)
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, firsts, offs = plan.value
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_rank"))
            at = np.searchsorted(starts, (length << 44) | rank, side="right") - 1
            found = [firsts[at] + rank - (starts[at] & ((1 << 44) - 1)), offs[at]]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in own), *map(pa.array, found)], names=[*own, "sequence_id", "offset"])

    return ranked.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset[, ids].

    Null and empty texts are a single ``end_id``.  Null ids are ids like others.  Repeated rows are
    packed once each.  Very long texts are tokenised whole and cut into full pieces.  An empty table
    gives an empty result.  Columns other than the two named ones are ignored, whatever their names.
    """
    pieces = stored(tokenize_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col, with_ids), "pieces", docs)
    return place(pieces, [id_col, "piece"], capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the sequences themselves, of ``pack_documents(..., with_ids=True)``.

    A sequence has at most ``capacity`` ids, so a group here is bounded.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
