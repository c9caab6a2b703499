"""Near-duplicate groups by b-bit MinHash (operator 8).

1. Whole texts become sets of 64-bit shingle hashes.  Texts of the same words in the same order, by a digest
   of these, are one class; a class has one representative from here on, so copies cost nothing more.
2. Of each set, ``bands * rows`` minima are taken and the low eight bits of each are kept: the packed
   signature.  ``rows`` bytes of it make a band key.  Classes that share a key share a bucket.
3. Buckets give candidates in two passes.  The first deals a bucket into blocks at random and takes for
   each member the few partners in its block that the signatures hold most similar: linear in the
   bucket.  These are confirmed on full sets and joined into components.  The second takes buckets where
   the first took less than all and more than one component is left.  It compares members of all but the
   largest component with everything else there, block by block, by signatures and then by sets of 32-bit
   hashes inside the task, and gives out one link for each two components that meet.  So of a group of
   thousands of near copies no more than a few pairs for each member ever become rows, and yet no
   bucket's pair is left unseen.  A pair is looked at in the first bucket that it shares.
4. Similarity is estimated from the number of equal bytes, corrected for bytes that are equal by chance.
   Only pairs that lie ``z`` standard errors below the threshold are passed over.
5. Links are confirmed on whole sets of 64-bit hashes that are independent of those which made the candidates,
   and components of all links are the groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import only, stored, text_of
from weftgraph.llm.wordhash import sets_and_digests, shingle_sets
from weftgraph.operators.components import connected_components

#: Members that one block of a bucket should hold, and partners that the first pass takes for each.
BLOCK, PARTNERS = 512, 3
#: The bitmap that singles out the texts whose sets are needed has 2 ** FILTER bits: 4 MB.
FILTER = 25
#: Seeds of the hashes that candidates and links come from.
FIND, CONFIRM = 0, 1
#: Chance that one byte of two different minima is equal.
CHANCE = 1 / 256


def _seeds(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 1 << 32, k, dtype=np.uint32), rng.integers(0, 1 << 31, k, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def signatures_of(sets: list[np.ndarray], k: int) -> np.ndarray:
    """One row of k bytes for each set: the low eight bits of its k minima.  Sets must not be empty."""
    out = np.zeros((len(sets), k), np.uint8)
    flips, factors = _seeds(k)
    a = 0
    while a < len(sets):  # some 32 K hashes at a time, so that they stay in the cache
        b, n = a, 0
        while b < len(sets) and (b == a or n + len(sets[b]) <= 1 << 15):
            n += len(sets[b])
            b += 1
        whole = np.concatenate(sets[a:b])
        h = ((whole >> np.uint64(32)) ^ whole).astype(np.uint32)
        starts = np.cumsum([0, *(len(x) for x in sets[a : b - 1])])
        work = np.empty_like(h)
        for j in range(k):
            np.bitwise_xor(h, flips[j], out=work)
            np.multiply(work, factors[j], out=work)
            low = np.minimum.reduceat(work, starts)
            out[a:b, j] = ((low * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)
        a = b
    return out


def signature_table(docs: DataFrame, id_col: str, text_col: str, width: int, k: int) -> DataFrame:
    """(id, n, digest, sig): set size, 128-bit digest of the words, packed signature (null for empty sets)."""
    own = only(docs, id_col, text_col).select(F.col(id_col), text_of(text_col).alias("_text"))
    kind = own.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, sizes, digests, sigs = [], [], [], []

            def flush() -> None:
                full = [s for s in sets if len(s)]
                rows = iter(signatures_of(full, k))
                sigs.extend(next(rows).tobytes() if len(s) else None for s in sets)
                sets.clear()

            held = 0
            for s, digest in sets_and_digests(batch.column(1), width, FIND):
                sets.append(s)
                sizes.append(len(s))
                digests.append(digest)
                held += len(s)
                if held > 1 << 17:
                    flush()
                    held = 0
            flush()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary())], names=[id_col, "n", "digest", "sig"])

    return own.mapInArrow(run, f"`{id_col}` {kind}, n bigint, digest binary, sig binary")


def _band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(sets, bands) of 64-bit keys; the band's number is part of the key."""
    keys = np.zeros((len(sig), bands), np.uint64)
    for r in range(rows):
        keys = (keys << np.uint64(8)) | sig[:, r :: rows][:, :bands].astype(np.uint64)
    return (keys | (np.arange(bands, dtype=np.uint64) << np.uint64(8 * rows))).view(np.int64)


def band_table(reps: DataFrame, bands: int, rows: int) -> DataFrame:
    """(key, id): the buckets of each representative."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            raw = batch.column(1)
            for a in range(0, len(ids), 1000):
                sig = np.frombuffer(b"".join(raw.slice(a, 1000).to_pylist()), np.uint8).reshape(-1, bands * rows)
                keys = _band_keys(sig, bands, rows)
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(np.repeat(ids[a : a + 1000], bands))], names=["key", "id"])

    return reps.select("id", "sig").mapInArrow(run, "key bigint, id bigint")


def _equal_bytes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(len(a), len(b)) counts of equal bytes; both are (n, lanes) of uint64."""
    out = np.zeros((len(a), len(b)), np.int32)
    ones = np.uint64(0x0101010101010101)
    for lane in range(a.shape[1]):
        x = a[:, lane, None] ^ b[None, :, lane]
        x |= x >> np.uint64(4)
        x |= x >> np.uint64(2)
        x |= x >> np.uint64(1)
        out += np.bitwise_count(x & ones)
    return 8 * a.shape[1] - out


def _close(sig_a: np.ndarray, n_a: np.ndarray, sig_b: np.ndarray, n_b: np.ndarray, band: int, rows: int, least: int, num: int, den: int) -> np.ndarray:
    """(len(a), len(b)) estimates in equal bytes; 0 where a pair is too far apart, or met in an earlier band."""
    if len(sig_a) * len(sig_b) <= 1024:
        equal = (sig_a[:, None, :] == sig_b[None, :, :]).sum(axis=2, dtype=np.int32)
    else:
        k = sig_a.shape[1]
        lanes = [np.ascontiguousarray(np.pad(x, ((0, 0), (0, -k % 8)))).view(np.uint64) for x in (sig_a, sig_b)]
        equal = _equal_bytes(*lanes) - (-k % 8)  # padding bytes are always equal
    equal[equal < least] = 0
    if not equal.any():
        return equal
    equal[np.minimum(n_a[:, None], n_b[None, :]) * den < num * np.maximum(n_a[:, None], n_b[None, :])] = 0
    if band and len(hits := np.argwhere(equal)):
        same = sig_a[hits[:, 0], : band * rows] == sig_b[hits[:, 1], : band * rows]
        seen = same.reshape(len(hits), band, rows).all(axis=2).any(axis=1)
        equal[hits[seen, 0], hits[seen, 1]] = 0
    return equal


def _runs(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """The groups of batches that are sorted by ``by``; a group may go on in the next batch."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        marks = [table.column(c).to_numpy() for c in by]
        new = np.zeros(len(table), bool)
        for m in marks:
            new[1:] |= m[1:] != m[:-1]
        cuts = [0, *np.flatnonzero(new).tolist()] if len(table) else []
        whole = table.combine_chunks()
        for a, b in zip(cuts, cuts[1:]):
            yield whole.slice(a, b - a)
        rest = whole.slice(cuts[-1]) if cuts else None
    if rest is not None and len(rest):
        yield rest


def _ints(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy().astype(np.int64)


def _sigs(table: pa.Table, k: int) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(-1, k)


_FOUND = "a bigint, b bigint, full_key bigint"


def _give(rows: list[tuple[np.ndarray, np.ndarray]], keys: list[int]) -> pa.RecordBatch:
    """Pairs, smaller id first, and then keys of buckets that have more to give."""
    a = np.concatenate([x for x, _ in rows]) if rows else np.zeros(0, np.int64)
    b = np.concatenate([x for _, x in rows]) if rows else np.zeros(0, np.int64)
    n, m = len(a), len(keys)
    none = pa.nulls(m, pa.int64())
    cols = [pa.concat_arrays([pa.array(f(a, b), pa.int64()), none]) for f in (np.minimum, np.maximum)]
    return pa.RecordBatch.from_arrays([*cols, pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(keys, pa.int64())])], names=["a", "b", "full_key"])


def near_links(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The ``pairs`` (a, b) with den * intersection >= num * union, on full ``sets`` (id, shingles)."""
    sa, sb = (sets.select(F.col("id").alias(c), F.col("shingles").alias(f"_{c}")) for c in "ab")
    both = pairs.join(sa.hint("merge"), "a").join(sb.hint("merge"), "b")
    inter = F.size(F.array_intersect("_a", "_b"))
    counted = both.select("a", "b", inter.cast("long").alias("i"), (F.size("_a") + F.size("_b")).cast("long").alias("s"))
    return counted.where(F.lit(den) * F.col("i") >= F.lit(num) * (F.col("s") - F.col("i"))).select("a", "b")


def _bitmap(ids: DataFrame) -> np.ndarray:
    """``1 << FILTER`` bits, of which those at the ids' hashes are set; of a fixed size whatever the ids."""
    at = F.pmod(F.xxhash64("id"), F.lit(1 << FILTER))
    got = ids.select((at + 1).alias("_at")).groupBy(F.bitmap_bucket_number("_at").alias("_b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_at")).alias("_bits")).collect()
    out = np.zeros((1 << FILTER) // 8, np.uint8)
    for r in got:
        start = (r["_b"] - 1) * len(r["_bits"])
        out[start : start + len(r["_bits"])] = np.frombuffer(r["_bits"], np.uint8)
    return out


def shingle_table(docs: DataFrame, id_col: str, text_col: str, width: int, ids: DataFrame) -> DataFrame:
    """(id, shingles): the sorted sets, as bigint, of the texts whose id is in ``ids`` (id).

    A bitmap of a fixed size keeps most other texts from being looked at and shuffled; the join after
    it is exact.
    """
    bits = docs.sparkSession.sparkContext.broadcast(_bitmap(ids))
    own = only(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("_text"), F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(1 << FILTER)).alias("_at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((bits.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1))
            begin, held, size = 0, [], 0
            for s in shingle_sets(batch.column(1), width, CONFIRM):
                held.append(s.view(np.int64))
                size += len(s)
                if size > 1 << 19:
                    yield _sets(batch.column(0).slice(begin, len(held)), held)
                    begin, held, size = begin + len(held), [], 0
            if held:
                yield _sets(batch.column(0).slice(begin, len(held)), held)

    return own.where("id is not null").mapInArrow(run, "id bigint, shingles array<bigint>").join(ids.distinct(), "id", "left_semi")


def _sets(ids: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
    offsets = np.cumsum([0, *(len(s) for s in sets)]).astype(np.int32)
    return pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets)))], names=["id", "shingles"])


def _part(n: Column) -> Column:
    """A block number for a member of a bucket that is dealt into n blocks; each bucket deals anew, so
    members of a group that are apart in one are together in another."""
    return F.pmod(F.xxhash64("id", "key"), n).cast("int")


def minhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 80, den: int = 100, bands: int = 32, rows: int = 5, z: float = 4.5, block: int = BLOCK
) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, kept.

    A-Z are lower-cased, words are ``[^\\x20\\x09-\\x0D]+``, a set is the distinct shingles of ``width``
    words, or the whole sequence where there are fewer.  Documents are linked where den * intersection
    >= num * union; component_id is the smallest id reachable and kept says that it is the document's
    own.  Null, empty and blank texts have empty sets and are linked with nothing.  Rows that share an
    id are one document here: linked, and kept alike.  A null id is linked only through an equal set and
    is kept where no other id is in its group (component_id null).  An empty table gives an empty
    result.  Other columns are ignored, whatever their names.  Ids must be integers.

    With the defaults a pair at the threshold shares no band with a chance below 1e-5, and the estimate
    passes over one with a chance below 1e-5.
    """
    if rows > 6 or bands > 0xFFFF:
        raise ValueError("a band key has up to six rows in 64 bits")
    k, share = bands * rows, num / den
    least = math.floor(k * (share + (1 - share) * CHANCE - z * math.sqrt(share * (1 - share) / k)))
    sigs = stored(signature_table(docs, id_col, text_col, width, k), "minhash", docs)
    classes = stored(sigs.where("n > 0").groupBy("digest").agg(F.min(F.col(id_col).cast("long")).alias("id"), F.any_value("n").alias("n"), F.any_value("sig").alias("sig")), "classes")
    reps = classes.where("id is not null").select("id", "n", "sig")
    keys = band_table(reps, bands, rows)
    # small tables by key are stored before they are joined: a join of two plain shuffles is one that adaptive
    # execution may split where a key is hot
    busy = stored(keys.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "busy")
    # bucket members with their signatures; only buckets of two or more
    members = stored(keys.join(busy, "key").join(reps.hint("merge"), "id"), "buckets")
    sets = stored(shingle_table(docs, id_col, text_col, width, members.select("id")), "sets")
    blocks = F.ceil(F.col("m") / F.lit(block)).cast("int")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows_, keys_, held = [], [], 0
        for table in _runs(batches, ["key", "_part"]):
            if len(table) < 2:
                continue
            key, id_, n, sig = table.column("key")[0].as_py(), _ints(table, "id"), _ints(table, "n"), _sigs(table, k)
            close = _close(sig, n, sig, n, (key >> (8 * rows)) & 0xFFFF, rows, least, num, den)
            np.fill_diagonal(close, 0)
            if not close.any():
                continue
            top = min(PARTNERS, len(id_) - 1)
            at = np.argpartition(-close, top - 1, axis=1)[:, :top]
            i, j = np.nonzero(np.take_along_axis(close, at, 1))
            rows_.append((id_[i], id_[at[i, j]]))
            if ((close > 0).sum(axis=1) > top).any():
                keys_.append(key)
            held += len(i)
            if held > 50_000:
                yield _give(rows_, keys_)
                rows_, keys_, held = [], [], 0
        yield _give(rows_, keys_)

    def dealt(df: DataFrame, by: list[str]) -> DataFrame:
        return df.repartition(tasks, *by).sortWithinPartitions(*by)

    parted = members.select("key", "id", "n", "sig", _part(blocks).alias("_part"))
    first = stored(dealt(parted, ["key", "_part"]).mapInArrow(best, _FOUND).distinct(), "pairs")
    pairs = first.where("full_key is null").select("a", "b")
    links = stored(near_links(pairs, sets, num, den), "links")
    found = stored(connected_components(links, "a", "b"), "found")

    # buckets that have more to give, and in which more than one component is left
    full = stored(first.where("full_key is not null").select(F.col("full_key").alias("key")).unionByName(busy.where(F.col("m") > block).select("key")).distinct(), "full")
    placed = members.join(full, "key", "left_semi").join(found, "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")
    placed = stored(placed, "placed")
    per = placed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"))
    split = per.groupBy("key").agg(F.max(F.struct("c", "comp")).alias("top"), F.count(F.lit(1)).alias("comps"), F.sum("c").alias("all")).where("comps > 1")
    split = stored(split.select("key", F.col("top.comp").alias("main"), (F.col("all") - F.col("top.c")).alias("few")), "split")
    short = sets.select("id", F.transform("shingles", lambda x: x.bitwiseAND(F.lit((1 << 31) - 1)).cast("int")).alias("short"))
    rest = placed.join(split, "key").join(short, "id")
    few_blocks = F.ceil(F.col("few") / F.lit(block)).cast("int")
    minor = F.col("comp") != F.col("main")
    spread = lambda n: F.sequence(F.lit(0), n - 1)
    cols = ["key", "id", "n", "sig", "comp", "short"]
    left = rest.where(minor).select(*cols, _part(few_blocks).alias("_i"), F.explode(spread(blocks)).alias("_j"), F.lit(1).alias("_left"))
    right = rest.select(*cols, F.explode(spread(few_blocks)).alias("_i"), _part(blocks).alias("_j"), F.lit(0).alias("_left"))

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, ["key", "_i", "_j"]):
            side, band = _ints(table, "_left") == 1, (table.column("key")[0].as_py() >> (8 * rows)) & 0xFFFF
            id_, n, sig, comp = _ints(table, "id"), _ints(table, "n"), _sigs(table, k), _ints(table, "comp")
            short_ = table.column("short")
            l, r = np.flatnonzero(side), np.flatnonzero(~side)
            if not len(l) or not len(r):
                continue
            out, certain = [], []
            for at in range(0, len(l), 256):
                part = l[at : at + 256]
                close = _close(sig[part], n[part], sig[r], n[r], band, rows, least, num, den)
                close[comp[part][:, None] == comp[r][None, :]] = 0
                for i in np.flatnonzero(close.any(axis=1)):
                    mine = np.sort(short_[int(part[i])].values.to_numpy())
                    others = r[close[i] > 0]
                    theirs = [short_[int(o)].values.to_numpy() for o in others]
                    flat = np.concatenate(theirs)
                    hit = mine[np.minimum(np.searchsorted(mine, flat), len(mine) - 1)] == flat
                    inter = np.add.reduceat(hit, np.cumsum([0, *(len(x) for x in theirs[:-1])]), dtype=np.int64)
                    union = len(mine) + np.array([len(x) for x in theirs]) - inter
                    chance = 2 + union // 100  # 32-bit hashes can meet by chance
                    near = (inter + chance) * den >= num * union
                    if near.any():
                        out.append((np.full(int(near.sum()), part[i]), others[near]))
                        certain.append(((inter - chance) * den >= num * (union + chance))[near])
            if out:
                i, j, sure = (np.concatenate(x) for x in ([x for x, _ in out], [x for _, x in out], certain))
                # one sure pair says all of its two components; without one all that may be near are looked at
                ends = np.stack([np.minimum(comp[i], comp[j]), np.maximum(comp[i], comp[j])], axis=1)
                _, which = np.unique(ends, axis=0, return_inverse=True)
                which = which.reshape(-1)
                order = np.lexsort((~sure, which))
                first_ = np.r_[True, which[order][1:] != which[order][:-1]]
                said = np.zeros(int(which.max()) + 1, bool)
                said[which[sure]] = True
                keep = order[first_ | ~said[which[order]]]
                yield _give([(id_[i[keep]], id_[j[keep]])], [])

    second = dealt(left.unionByName(right), ["key", "_i", "_j"]).mapInArrow(across, _FOUND).select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti")
    more = near_links(stored(second, "pairs"), sets, num, den)
    # links of the second pass join components of the first
    of = lambda c: found.select(F.col("id").alias(c), F.col("component").alias(f"_{c}"))
    joined = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("_a", "a").alias("x"), F.coalesce("_b", "b").alias("y")).distinct()
    over = stored(connected_components(joined, "x", "y"), "joined").withColumnsRenamed({"id": "_cid", "component": "_top"})
    low = found.join(over, F.col("component") == F.col("_cid"), "left").select("id", F.coalesce("_top", "component").alias("component"))
    groups = low.unionByName(over.join(found, F.col("_cid") == F.col("id"), "left_anti").select(F.col("_cid").alias("id"), F.col("_top").alias("component")))
    by_digest = classes.join(groups, "id", "left").select("digest", F.coalesce("component", "id").alias("component_id"))
    own = F.col(id_col).cast("long")
    empty = sigs.where("n = 0").select(id_col, F.col("n").alias("n_shingles"), own.alias("component_id"))
    full = sigs.where("n > 0").join(by_digest, "digest", "left").select(id_col, F.col("n").alias("n_shingles"), "component_id")
    return full.unionByName(empty).withColumn("kept", own.eqNullSafe(F.col("component_id")))
