"""Exact dedup (operator 2): per-partition counting quotient filters, merged by sorted remainders.

1. Every text is normalised (runs of ASCII white space become one space) and fingerprinted with 64
   bits in the JVM.  The narrow table (id, fingerprint, SHA-256) is stored once.
2. Each partition builds counting quotient filters of its fingerprints, cut by the fingerprint's high
   bits into blocks; blocks are shuffled and merged without loss.  A hot text is one slot with a
   counter in each partition's filter, never many rows.
3. Fingerprints with a count above one route their documents to byte verification: whole normalised
   texts are the grouping key of an aggregate that combines before its shuffle, so of a group of copies
   each task ships one text.  Equal fingerprints of different texts part here.  Up to ``FEW`` such
   fingerprints go to the texts; beyond that texts go to them, dealt by fingerprint and a salt of the id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import cqf
from weftgraph.llm.common import normalise_space, only, stored, text_of, width

#: Fingerprints that one merged block should hold at most, and that one partition gathers before it flushes.
BLOCK, FLUSH = 1 << 21, 1 << 22
#: Into how many parts each fingerprint's texts are dealt on their way to verification.
SALTS = 32
#: So many fingerprints or ids of 8 bytes are broadcast at most; a longer list is joined by a shuffle.
FEW = 1 << 19


def repeated_fingerprints(fps: DataFrame, block_bits: int) -> DataFrame:
    """Rows (fp, n) of the ``fps`` (one bigint column ``fp``, no nulls) that occur more than once."""
    bits = 64 - block_bits

    def blocks(values: np.ndarray) -> Iterator[pa.RecordBatch]:
        values = np.sort(values)
        block = (values >> np.uint64(bits)).astype(np.int64) if block_bits else np.zeros(len(values), np.int64)
        starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        low = values & np.uint64((1 << bits) - 1)
        for part in np.array_split(starts, max(1, len(starts) // 512)):
            ends = np.r_[part[1:], starts[starts > part[-1]][:1] if (starts > part[-1]).any() else [len(values)]].astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(block[part], pa.int64()), pa.array([cqf.build(low[a:b], None, bits) for a, b in zip(part, ends)], pa.binary())],
                names=["block", "filter"],
            )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            n += len(held[-1])
            if n >= FLUSH:
                yield from blocks(np.concatenate(held))
                held, n = [], 0
        if n:
            yield from blocks(np.concatenate(held))

    def merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        values, counts = cqf.decode(cqf.merge(table.column("filter").to_pylist(), bits))
        many = counts > 1
        whole = values[many] | (np.uint64(key[0].as_py()) << np.uint64(bits) if block_bits else np.uint64(0))
        return pa.table({"fp": pa.array(whole.view(np.int64)), "n": pa.array(counts[many].astype(np.int64))})

    filters = fps.mapInArrow(build, "block bigint, filter binary")
    return filters.groupBy("block").applyInArrow(merge, "fp bigint, n bigint")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fingerprint=None) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after each ``[\\x20\\x09-\\x0D]+`` became one space; null
    counts as empty.  The smallest id of a group stays.  A null id never keeps a group that has
    another; in a group of null ids only, keep_id is null and all rows are kept.  Rows that repeat an
    id and a text are all marked alike (``drop_exact_duplicates`` leaves one of them).  An empty table
    gives an empty result.  Other columns are ignored, whatever their names.
    ``fingerprint`` replaces the 64-bit hash in tests that force collisions.
    """
    own = only(docs, id_col, text_col).select(F.col(id_col).alias("_id"), normalise_space(text_of(text_col)).alias("_norm"))
    own = own.withColumn("_fp", (fingerprint or F.xxhash64)(F.col("_norm")))
    narrow = stored(own.select("_id", F.col("_fp").alias("fp"), F.sha2("_norm", 256).alias("sha")), "exact", docs)
    # blocks as large as a task can hold, so that filters are not a slot each; as many as tasks at least
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block_bits = max(tasks.bit_length(), (narrow.count() // BLOCK).bit_length() + 1)
    repeated = stored(repeated_fingerprints(narrow.select("fp"), block_bits).select(F.col("fp").alias("_fp")), "repeated")
    if repeated.count() <= FEW:
        texts = own.join(F.broadcast(repeated), "_fp", "left_semi")  # at most FEW longs; no text moves before it is combined
    else:
        salted = repeated.select("_fp", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
        texts = own.withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(SALTS)).cast("int")).join(salted, ["_fp", "_salt"], "left_semi")
    groups = texts.groupBy("_fp", "_norm").agg(F.min("_id").alias("keep"), F.count(F.lit(1)).alias("size"))
    groups = groups.select(F.col("_fp").alias("fp"), F.sha2("_norm", 256).alias("sha"), "keep", "size")
    return narrow.join(groups, ["fp", "sha"], "left").select(
        F.col("_id").alias(id_col),
        F.when(F.col("size").isNull(), F.col("_id")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("size").isNull() | F.col("_id").eqNullSafe(F.col("keep"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all columns but without the rows that an equal text of a smaller id replaces.

    Of rows that repeat an id and a text one stays, whichever.  Where ids are keys, whole rows move once.
    """
    found = stored(exact_dedup(docs, id_col, text_col), "verdicts")
    gone = found.where(~F.col("kept")).select(F.col(id_col).alias("_gone"), F.col("text_sha256").alias("_sha")).distinct()
    # an id alone names the row unless it has several texts
    several = found.groupBy(id_col).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select(F.col(id_col).alias("_id2"))
    if several.isEmpty():
        return drop_ids(docs, gone.select("_gone"), id_col)
    name = "_weft_text_sha256"
    key = F.sha2(normalise_space(text_of(docs[text_col])), 256)
    hashed = docs.withColumn(name, key)
    rest = hashed.join(gone, hashed[id_col].eqNullSafe(gone["_gone"]) & (hashed[name] == gone["_sha"]), "left_anti")
    ties = rest.join(several, rest[id_col].eqNullSafe(several["_id2"]), "left_semi").dropDuplicates([id_col, name])
    return rest.join(several, rest[id_col].eqNullSafe(several["_id2"]), "left_anti").unionByName(ties).drop(name)


def drop_ids(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs``, all columns, without the rows whose id is in the one column of ``gone``, which is read more than once.

    Up to ``FEW`` ids of a fixed width go to the rows.  Else rows and ids meet by a shuffle: the ids are the
    hashed side, so whole rows are never sorted, and rows are dealt to as many partitions as their size
    asks for, which are the files that a caller writes.
    """
    ids = gone.toDF("_weft_gone").distinct()
    fixed = dict(ids.dtypes)["_weft_gone"] in ("tinyint", "smallint", "int", "bigint")
    if fixed and ids.limit(FEW + 1).count() <= FEW:
        return docs.join(F.broadcast(ids), docs[id_col].eqNullSafe(F.col("_weft_gone")), "left_anti")
    n = width(docs)
    key = lambda c: [F.coalesce(c.cast("string"), F.lit("")).alias("_weft_k"), c.isNull().alias("_weft_none")]
    ids = ids.select(*key(F.col("_weft_gone"))).repartition(n, "_weft_k", "_weft_none").hint("shuffle_hash")
    rows = docs.select("*", *key(docs[id_col])).repartition(n, "_weft_k", "_weft_none")
    return rows.join(ids, ["_weft_k", "_weft_none"], "left_anti").select(*docs.columns)
