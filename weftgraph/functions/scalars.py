"""Scalar helpers as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TIME_FORMAT = "MM/dd/yyyy HH:mm:ss"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def chars_replace(s: Column | str, old: str, new: str) -> Column:
    """Each character of ``old`` becomes its partner in ``new``; those without one go; the first of two wins (F1)."""
    return F.translate(_c(s), old, new)


def _java(replacement: str) -> str:
    """``$0`` to ``$9`` stay references, ``\\x`` is x itself."""
    return re.sub(r"\\(.)", lambda m: "\\" + m[1] if m[1] in "$\\" else m[1], replacement)


def regex_replace(s: Column | str, pattern: str, replacement: str, options: str = "") -> Column:
    """s/// with options g (all matches, else the first) and i (any case); $0 to $9 name groups (F2, F16)."""
    p = "(?i)" + pattern if "i" in options else pattern
    r = _java(replacement)
    if "g" in options:
        return F.regexp_replace(_c(s), p, r)
    # the first match only: what is before it is matched lazily, groups move up by one
    moved = re.sub(r"(\\.)|\$(\d)", lambda m: m[1] or f"${int(m[2]) + 2}", r)
    return F.regexp_replace(_c(s), f"(?s)^(.*?)({p})", "$1" + moved)


def regex_matches(s: Column | str, pattern: str, options: str = "") -> Column:
    """How many replacements ``regex_replace`` makes."""
    n = F.regexp_count(_c(s), F.lit("(?i)" + pattern if "i" in options else pattern))
    return n if "g" in options else F.least(n, F.lit(1))


def trim_end(s: Column | str, chars: str) -> Column:
    """(F3)"""
    return F.rtrim(_c(s), F.lit(chars))


def trim_start(s: Column | str, chars: str) -> Column:
    """(F4)"""
    return F.ltrim(_c(s), F.lit(chars))


def upper(s: Column | str) -> Column:
    return F.upper(_c(s))


def lower(s: Column | str) -> Column:
    return F.lower(_c(s))


def equal_any_case(a: Column | str, b: Column | str) -> Column:
    """1 if equal in any case, else 0."""
    return (F.lower(_c(a)) == F.lower(_c(b))).cast("int")


def compare_reversed(a: Column | str, b: Column | str) -> Column:
    """-1, 0 or 1: order by characters from the end; a suffix comes before the longer string (F8)."""
    x, y = F.reverse(_c(a)), F.reverse(_c(b))
    return F.when(x < y, -1).when(x > y, 1).otherwise(0)


def string_id(mapping: dict[str, int], key: Column | str) -> Column:
    """The id of a name in any case, -1 if it has none."""
    if not mapping:
        return F.lit(-1)
    table = F.create_map(*[F.lit(x) for k, v in mapping.items() for x in (k.lower(), v)])
    return F.coalesce(F.try_element_at(table, F.lower(_c(key))), F.lit(-1))


def tokenize(s: Column | str, delimiters: str) -> Column:
    """Tokens between runs of delimiters, none empty."""
    inside = "".join("\\" + c if not c.isalnum() and not c.isspace() else c for c in delimiters)
    return F.filter(F.split(_c(s), f"[{inside}]+"), lambda x: x != "")


def time_to_string(t: Column | str) -> Column:
    """(F11)"""
    return F.date_format(_c(t), TIME_FORMAT)


def string_to_time(s: Column | str) -> Column:
    """Seconds since 1970 in the session's zone; -1 if it can't be read, 0 if it is before."""
    t = F.unix_timestamp(F.try_to_timestamp(_c(s), F.lit(TIME_FORMAT)))
    return F.when(t.isNull(), F.lit(-1)).otherwise(F.greatest(t, F.lit(0)))


def floor_log2(x: Column | str) -> Column:
    """Whole part of log2 of an integer, 0 up to 1."""
    return F.when(_c(x) <= 1, 0).otherwise(F.length(F.bin(_c(x))) - 1)


def is_power_of_two(x: Column | str) -> Column:
    return (_c(x) > 0) & (F.bit_count(_c(x)) == 1)


def log2(x: Column | str) -> Column:
    return F.log2(_c(x))


def sign_of(a: Column | str, b: Column | str) -> Column:
    """b if a is not negative, else -b."""
    return F.when(_c(a) >= 0, _c(b)).otherwise(-_c(b))


def max3(a: Column | str, b: Column | str, c: Column | str) -> Column:
    return F.greatest(_c(a), _c(b), _c(c))


def random_in_range(n: int, seed: int, key: Column | str | None = None) -> Column:
    """Whole numbers from 0 to n - 1 (F15); with a ``key`` a row's number depends on seed and key alone, so
    it is the same however rows are dealt and tasks are repeated."""
    if key is None:
        return F.floor(F.rand(seed) * n).cast("long")
    return F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), _c(key).cast("string"))), 1, 12), 16, 10).cast("long"), F.lit(n)).cast("long")


def with_commas(x: Column | str) -> Column:
    """(F19)"""
    return F.format_number(_c(x), 0)


def base64_encode(b: Column | str) -> Column:
    """Base64 of bytes whose number is a multiple of 3, so without padding."""
    return F.when(F.octet_length(_c(b)) % 3 == 0, F.base64(_c(b))).otherwise(F.raise_error(F.lit("the length must be a multiple of 3")))


def base64_decode(s: Column | str) -> Column:
    return F.when(F.length(_c(s)) % 4 == 0, F.unbase64(_c(s))).otherwise(F.raise_error(F.lit("the length must be a multiple of 4")).cast("binary"))


def symbol_codes(s: Column | str, alphabet: str) -> Column:
    """The place of each character in ``alphabet``, -1 if it is not there."""
    places = {c: i for i, c in reversed(list(enumerate(alphabet)))}
    table = F.create_map(*[F.lit(x) for kv in places.items() for x in kv])
    return F.transform(F.filter(F.split(_c(s), ""), lambda x: x != ""), lambda x: F.coalesce(F.try_element_at(table, x), F.lit(-1)))
