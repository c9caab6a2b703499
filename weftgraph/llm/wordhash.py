"""Words of many texts at once, as 64-bit hashes, on the bytes of an Arrow string column.

A word of up to ``LONG`` bytes is hashed in lanes of eight bytes: each lane goes into the state and the
state through a finaliser before the next one comes, so no arithmetic of lanes cancels out, whatever
pattern a word has.  A longer word is hashed by BLAKE2b.  Different seeds give independent hashes.  No text
becomes a Python string here.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Longer words are hashed one by one.
LONG = 64
_BYTES = np.arange(256, dtype=np.uint8)
#: A-Z become a-z; all other bytes stay.
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
IS_SPACE = (_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D))
#: Bytes of texts that are worked on together, so that the arrays stay in the cache.
SLICE = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A published 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets from 0) of runs of rows of about ``SLICE`` bytes; a longer text is alone."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if len(column) == 0:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + SLICE, side="right")) - 1)
        yield a, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def _const(x: int) -> np.uint64:
    return np.uint64(x & 0xFFFFFFFFFFFFFFFF)


_K = [0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F]
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of the texts of a slice.

    ``start``, ``end``: byte ranges; ``hash``: of the bytes; ``first``: for each text the number of its
    first word, with the number of all words at the end.  A slice is looked through in windows of ``window``
    bytes, so besides the text only a few numbers a word are held, however long a text or a word is.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True, window: int = SLICE, seed: int = 0):
        whole = np.zeros(len(data) + 8, np.uint8)  # a lane may be read from any byte
        whole[: len(data)] = LOWER[data] if lower else data
        self.bytes = whole[: len(data)]
        self._lanes = np.ndarray(len(data) + 1, "<u8", whole, strides=(1,))
        self.start, self.end = self._words(data, offsets, window)
        self.first = np.searchsorted(self.start, offsets)
        self.seed = seed
        self.hash = self._hashes(self.start, self.end - self.start)

    @staticmethod
    def _words(data: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
        starts, ends = [], []
        for a in range(0, len(data), window):
            n = min(window, len(data) - a)
            gap = np.ones(n + 2, bool)
            lo, hi = max(a - 1, 0), min(a + n + 1, len(data))
            gap[lo - a + 1 : hi - a + 1] = IS_SPACE[data[lo:hi]]
            bounds = np.zeros(n + 1, bool)
            bounds[offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, a + n, side="right")] - a] = True
            word = ~gap[1:-1]
            starts.append(np.flatnonzero(word & (gap[:-2] | bounds[:-1])) + a)
            ends.append(np.flatnonzero(word & (gap[2:] | bounds[1:])) + 1 + a)
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return join(starts), join(ends)

    def lane(self, start: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The ``n`` bytes (0 to 8) from each ``start`` on as a number."""
        return self._lanes[start] & _MASKS[n]

    def _hashes(self, start: np.ndarray, n: np.ndarray) -> np.ndarray:
        state = mix(n.astype(np.uint64) * _const(_K[0]) + _const(0xD1B54A32D192ED03 * (2 * self.seed + 1)))
        state = mix(state ^ self.lane(start, np.minimum(n, 8)))
        rest = np.flatnonzero((n > 8) & (n <= LONG))
        at = 8
        while len(rest):
            state[rest] = mix((state[rest] ^ self.lane(start[rest] + at, np.minimum(n[rest] - at, 8))) * _const(_K[1]))
            at += 8
            rest = rest[n[rest] > at]
        for i in np.flatnonzero(n > LONG).tolist():
            digest = hashlib.blake2b(self.bytes[start[i] : start[i] + n[i]], digest_size=8, salt=self.seed.to_bytes(8, "little")).digest()
            state[i] = int.from_bytes(digest, "little")
        return state

    def beginning_hash(self, start: np.ndarray, n: int) -> np.ndarray:
        """Hashes of the n bytes from each ``start`` on, as of a word of these bytes."""
        return self._hashes(start, np.full(len(start), n))

    def digests(self) -> Iterator[bytes]:
        """For each text a digest of its words in order: equal for texts with the same words only."""
        length = (self.end - self.start).astype("<u8")
        ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
        inside = np.zeros(len(self.bytes) + 1, np.int8)
        inside[self.start] += 1
        np.subtract.at(inside, self.end, 1)
        letters = self.bytes[np.cumsum(inside[:-1], dtype=np.int8) > 0]
        for a, b in zip(self.first[:-1].tolist(), self.first[1:].tolist()):
            own = hashlib.blake2b(length[a:b], digest_size=16)
            own.update(letters[ends[a] : ends[b]])
            yield own.digest()

    def sets(self, width: int) -> Iterator[np.ndarray]:
        """For each text the sorted distinct hashes of its shingles of ``width`` words.

        A text with fewer words is one shingle of all of them; one without words has none.
        """
        h, first = self.hash, self.first
        n = max(0, len(h) - width + 1)
        rolled = np.zeros(n, np.uint64)
        for j in range(width):
            rolled = mix((rolled ^ h[j : j + n]) * _const(_K[(j + 1) % 5]) + _const(_K[j % 5] * (2 * j + 1)))
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= width:
                yield np.unique(rolled[a : b - width + 1])
            elif b > a:
                own = np.array([b - a], np.uint64)
                for j in range(a, b):
                    own = mix(own * _const(_K[0]) ^ h[j : j + 1])
                yield own
            else:
                yield np.zeros(0, np.uint64)


def shingle_sets(column: pa.Array, width: int, seed: int = 0) -> Iterator[np.ndarray]:
    """``Words.sets`` of each text of a column, in order."""
    for _, data, offsets in slices(column):
        yield from Words(data, offsets, seed=seed).sets(width)


def sets_and_digests(column: pa.Array, width: int, seed: int = 0) -> Iterator[tuple[np.ndarray, bytes]]:
    """``Words.sets`` and ``Words.digests`` of each text of a column, in order."""
    for _, data, offsets in slices(column):
        words = Words(data, offsets, seed=seed)
        yield from zip(words.sets(width), words.digests())
