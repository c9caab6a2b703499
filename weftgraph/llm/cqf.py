"""A counting quotient filter over 64-bit fingerprints, on numpy.

A fingerprint is split into a quotient (its high bits) and a remainder (the rest).  Remainders of one
quotient form a run, sorted; runs lie one after another.  Two bit vectors say where they are:
``occupied`` has a bit for each quotient that has a run, ``runend`` a bit for each slot that ends one.
A slot whose count is above one is flagged in ``counted`` and has a counter.  Quotient and remainder
together are the whole fingerprint, so filters merge losslessly: equal remainders of equal quotients
add their counts and nothing else changes.
"""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<QBBQ")  # slots, quotient bits, remainder bytes, counters


def build(values: np.ndarray, counts: np.ndarray | None, bits: int) -> bytes:
    """The filter of ``values`` (uint64, each below 2**bits); ``counts`` None means one each."""
    order = np.argsort(values, kind="stable")
    values = values[order].astype(np.uint64)
    weights = np.ones(len(values), np.uint64) if counts is None else counts[order].astype(np.uint64)
    first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)
    slots = values[first]
    totals = np.add.reduceat(weights, first) if len(first) else np.zeros(0, np.uint64)
    n = len(slots)
    qbits = min(bits, max(0, int(n - 1).bit_length())) if n else 0
    rbits = bits - qbits
    quotient = (slots >> np.uint64(rbits)) if rbits < 64 else np.zeros(n, np.uint64)
    remainder = slots & np.uint64((1 << rbits) - 1)
    width = max(1, (rbits + 7) // 8)
    occupied = np.zeros(1 << qbits, bool)
    occupied[quotient.astype(np.int64)] = True
    runend = np.r_[quotient[1:] != quotient[:-1], True] if n else np.zeros(0, bool)
    counted = totals > 1
    packed = remainder.astype("<u8").view(np.uint8).reshape(n, 8)[:, :width] if n else np.zeros((0, width), np.uint8)
    return b"".join(
        [
            _HEAD.pack(n, qbits, width, int(counted.sum())),
            bytes([bits]),
            np.packbits(occupied).tobytes(),
            np.packbits(runend).tobytes(),
            np.packbits(counted).tobytes(),
            packed.tobytes(),
            totals[counted].astype("<u8").tobytes(),
        ]
    )


def decode(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The sorted values and their counts."""
    n, qbits, width, extra = _HEAD.unpack_from(blob)
    bits, at = blob[_HEAD.size], _HEAD.size + 1
    rbits = bits - qbits

    def flags(size: int) -> np.ndarray:
        nonlocal at
        got = np.unpackbits(np.frombuffer(blob, np.uint8, (size + 7) // 8, at), count=size).astype(bool)
        at += (size + 7) // 8
        return got

    occupied, runend, counted = flags(1 << qbits), flags(n), flags(n)
    raw = np.zeros((n, 8), np.uint8)
    raw[:, :width] = np.frombuffer(blob, np.uint8, n * width, at).reshape(n, width)
    at += n * width
    run = np.cumsum(runend) - runend  # which run a slot is in
    quotient = np.flatnonzero(occupied)[run].astype(np.uint64)
    values = raw.reshape(-1).view("<u8").astype(np.uint64)
    if rbits < 64:
        values = values | (quotient << np.uint64(rbits))
    counts = np.ones(n, np.uint64)
    counts[counted] = np.frombuffer(blob, "<u8", extra, at)
    return values, counts


def merge(blobs: list[bytes], bits: int) -> bytes:
    """One filter that counts what all count."""
    parts = [decode(b) for b in blobs]
    return build(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), bits)
