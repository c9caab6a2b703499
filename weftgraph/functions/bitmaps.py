"""Bit sets as arrays of 64-bit words (U3, U4), bit i in word i div 64."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def from_members(df: DataFrame, key: str, member: str, size: int) -> DataFrame:
    """(key, bits): the set of each key's members, which are 0 to size - 1."""
    n = (size + 63) // 64
    words = df.groupBy(key, F.floor(F.col(member) / 64).cast("int").alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({member} % 64 as int))")).alias("m"))
    table = words.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("w", "m"))).alias("t"))
    return table.select(key, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.try_element_at("t", i), F.lit(0))).alias("bits"))


def _zip(a: Column | str, b: Column | str, f) -> Column:
    zero = lambda x: F.coalesce(x, F.lit(0).cast("long"))
    return F.zip_with(a, b, lambda x, y: f(zero(x), zero(y)))


def and_(a: Column | str, b: Column | str) -> Column:
    return _zip(a, b, lambda x, y: x.bitwiseAND(y))


def or_(a: Column | str, b: Column | str) -> Column:
    return _zip(a, b, lambda x, y: x.bitwiseOR(y))


def xor(a: Column | str, b: Column | str) -> Column:
    return _zip(a, b, lambda x, y: x.bitwiseXOR(y))


def and_not(a: Column | str, b: Column | str) -> Column:
    return _zip(a, b, lambda x, y: x.bitwiseAND(F.bitwise_not(y)))


def not_(a: Column | str, size: int) -> Column:
    """All bits of 0 to size - 1 that are not set."""
    n, tail = (size + 63) // 64, size % 64
    last = (1 << tail) - 1 if tail else -1
    return F.transform(a, lambda x, i: F.when(i == n - 1, F.bitwise_not(x).bitwiseAND(F.lit(last).cast("long"))).otherwise(F.bitwise_not(x)))


def or_all(*sets: Column | str) -> Column:
    out = sets[0] if isinstance(sets[0], Column) else F.col(sets[0])
    for s in sets[1:]:
        out = or_(out, s)
    return out


def get(a: Column | str, i: Column) -> Column:
    a = F.col(a) if isinstance(a, str) else a
    word = F.coalesce(F.get(a, F.floor(i / 64).cast("int")), F.lit(0).cast("long"))
    return F.call_function("bit_get", word, (i % 64).cast("int")) == 1


def count(a: Column | str) -> Column:
    """Bits that are set (U4)."""
    return F.aggregate(a, F.lit(0), lambda acc, x: acc + F.bit_count(x))


def to_bytes(a: Column | str) -> Column:
    """Hex of the words, eight bytes each, most significant first."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def from_bytes(s: Column) -> Column:
    """Back from ``to_bytes``."""
    n = F.floor(F.length(s) / 16).cast("int")
    word = lambda i: F.conv(F.substring(s, i * 16 + 1, F.lit(16)), 16, -10).cast("long")
    return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), word))


def append(a: Column | str, b: Column | str) -> Column:
    """Whole words one behind the other."""
    return F.concat(a, b)
