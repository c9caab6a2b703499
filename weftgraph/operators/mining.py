"""Frequent itemsets, level by level or from conditional tables by prefix."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.storage import discard, stored


def frequent_itemsets(tx: DataFrame, min_freq: int, max_freq: int = -1, min_len: int = 1, max_len: int = -1, with_tids: bool = False) -> DataFrame:
    """(items, support[, tids]) of all itemsets of min_len to max_len items with support >= min_freq.

    ``tx`` is (tid, item); a repeated item of a transaction counts once.  Items with support above
    ``max_freq`` take no part; -1 is no bound.  Each level extends the transactions' frequent prefixes by
    later frequent items, and keeps what is frequent without its first item, so a level's rows are
    occurrences of candidates, and what isn't frequent goes at once.
    """
    rows = tx.where("tid is not null and item is not null").select("tid", "item").distinct()
    counts = rows.groupBy("item").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_freq)
    counts = counts if max_freq < 0 else counts.where(F.col("n") <= max_freq)
    rows = stored(rows.join(counts.select("item"), "item", "left_semi"), "tx")
    level, found, k = rows.select("tid", F.array("item").alias("items")), [], 1
    while True:
        tids = [F.sort_array(F.collect_list("tid")).alias("tids")] if with_tids else []
        sets = stored(level.groupBy("items").agg(F.count(F.lit(1)).alias("support"), *tids).where(F.col("support") >= min_freq), "sets")
        if sets.isEmpty():
            break
        if k >= min_len:
            found.append(sets)
        if k == max_len:
            break
        good = level.join(sets.select("items"), "items", "left_semi")
        nxt = good.join(rows, "tid").where(F.col("item") > F.element_at("items", -1)).select("tid", F.concat("items", F.array("item")).alias("items"))
        if k > 1:  # what is behind the first item must be frequent too
            nxt = nxt.withColumn("_tail", F.slice("items", 2, k)).join(sets.select(F.col("items").alias("_tail")), "_tail", "left_semi").select("tid", "items")
        before, level = level, stored(nxt, "level")
        if k > 1:
            discard(before)
        k += 1
    if not found:
        return tx.sparkSession.createDataFrame([], sets.schema)
    return reduce(DataFrame.unionByName, found)


def _longer(head: list[int], items: list[tuple[int, np.ndarray]], least: int, room: int) -> Iterator[tuple[list[int], np.ndarray]]:
    """Frequent sets of two items or more, ``room`` at most, behind ``head``, depth first; ``items`` are (number, sorted transactions)."""
    for i, (item, tids) in enumerate(items):
        met = ((other, np.intersect1d(tids, those, assume_unique=True)) for other, those in items[i + 1 :])
        ahead = [(other, both) for other, both in met if len(both) >= least]
        for other, both in ahead:
            yield [*head, item, other], both
        if room > 2 and len(ahead) > 1:
            yield from _longer([*head, item], ahead, least, room - 1)


def projected_itemsets(tx: DataFrame, min_freq: int, max_freq: int = -1, min_len: int = 1, max_len: int = -1, with_tids: bool = False, most: int = 1_000_000) -> DataFrame:
    """(items, support[, tids]) as of ``frequent_itemsets``, from conditional tables.

    The table of a prefix holds, for each transaction with all of its items, the frequent items behind its
    last one; items go by rising support, so what is frequent has short tails.  A table of up to ``most``
    rows is mined depth-first by one task; a larger one is projected once more, by each of its items.  Jobs
    follow the size of the largest table, not the length of the longest set.

    Null transactions and items take no part and repeats count once; without transactions there are no
    rows.  A very long transaction has as many tails as pairs of its frequent items, which are joined by
    (prefix, transaction), so adaptive execution can split it.
    """
    if min_freq < 1 or most < 1:
        raise ValueError("min_freq and most are at least 1")
    kind, tid_kind = tx.schema["item"].dataType, tx.schema["tid"].dataType
    tids = [F.sort_array(F.collect_list("tid")).alias("tids")] if with_tids else []
    rows = tx.where("tid is not null and item is not null").select("tid", "item").distinct()
    counts = rows.groupBy("item").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_freq)
    counts = counts if max_freq < 0 else counts.where(F.col("n") <= max_freq)
    root = F.array().cast(f"array<{kind.simpleString()}>")
    table = stored(rows.join(counts, "item").select(root.alias("prefix"), "tid", "item", "n"), "tx")
    sets = table.groupBy("prefix", "item").agg(F.count(F.lit(1)).alias("support"), *tids)
    schema = f"items array<{kind.simpleString()}>, support bigint" + (f", tids array<{tid_kind.simpleString()}>" if with_tids else "")
    names = ["items", "support", *(["tids"] if with_tids else [])]
    whole = lambda df: df.select(F.sort_array(F.concat("prefix", F.array("item"))).alias("items"), *names[1:])
    found, k = [whole(sets)], 1

    def mine(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches)).sort_by([("n", "ascending"), ("item", "ascending"), ("tid", "ascending")])
        item, tid = (held.column(c).combine_chunks().dictionary_encode() for c in ("item", "tid"))
        number, who = item.indices.to_numpy(), tid.indices.to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)]
        lists = [(int(number[a]), np.sort(who[a:b])) for a, b in zip(cuts, cuts[1:])]
        prefix, of, by = key[0].as_py(), item.dictionary, tid.dictionary
        room = len(number) if max_len < 0 else max_len - len(prefix)
        out, size = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(out, pa.schema([("items", pa.list_(of.type)), ("support", pa.int64())] + ([("tids", pa.list_(by.type))] if with_tids else [])))

        for numbers, both in _longer([], lists, min_freq, room):
            one = {"items": sorted([*prefix, *(of[i].as_py() for i in numbers)]), "support": len(both)}
            out.append({**one, "tids": sorted(by.take(pa.array(both)).to_pylist())} if with_tids else one)
            size += len(numbers) + (len(both) if with_tids else 0)
            if size >= 1 << 18:
                yield batch()
                out, size = [], 0
        if out:
            yield batch()

    while k != max_len:
        last = F.struct("n", "item")
        heads = table.select(F.concat("prefix", F.array("item")).alias("_longer"), "prefix", "tid", last.alias("_last"))
        tails = heads.join(table, ["prefix", "tid"]).where(last > F.col("_last")).select(F.col("_longer").alias("prefix"), "tid", "item", "n")
        sets = stored(tails.groupBy("prefix", "item").agg(F.count(F.lit(1)).alias("support"), *tids).where(F.col("support") >= min_freq), "sets")
        found.append(whole(sets))
        k += 1
        sizes = sets.groupBy("prefix").agg(F.sum("support").alias("size"), F.count(F.lit(1)).alias("_items")).where("_items > 1")
        good = sets.select("prefix", "item").join(sizes.select("prefix", "size"), "prefix")
        table = stored(tails.join(good, ["prefix", "item"]), "conditional")
        if k == max_len or table.isEmpty():
            break
        found.append(table.where(F.col("size") <= most).select("prefix", "tid", "item", "n").groupBy("prefix").applyInArrow(mine, schema))
        table = table.where(F.col("size") > most).drop("size")
        if table.isEmpty():
            break
    return reduce(DataFrame.unionByName, found).where(F.size("items") >= min_len)
