"""Token counts without tokens: Viterbi over a unigram vocabulary (operator 10).

The tokenizer meant is a unigram model behind two pre-tokenizers: white space
``[\\x20\\x09-\\x0D]+`` parts a text into words, and each word gets the mark U+2581 in front if it doesn't start with one.  Words are
segmented one by one, so a text's count is the sum of its words' and a word is segmented once for all
its places.  Of a word, an Aho-Corasick automaton enumerates the vocabulary's matches by their end; the
best score and the number of pieces of the best segmentation are carried from character to character,
and no segmentation is kept.  Ties and unknowns follow the ``tokenizers`` library: of equal scores the
piece that starts earliest wins; a character that no single-character piece covers is an unknown of the
lowest score less ten, and falls back to its UTF-8 bytes, or where that is off, counts as one piece
together with unknowns next to it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import only, text_of
from weftgraph.llm.wordhash import Words, slices

MARK = "▁"
#: Fixed value of that library: what an unknown costs more than the worst piece.
UNKNOWN_PENALTY = 10.0
#: Words whose counts a worker remembers before it starts anew, and bytes of a word that it remembers at most.
REMEMBERED, SHORT = 1 << 19, 64


def read_vocabulary(path: str) -> tuple[list[tuple[str, float]], bool]:
    """((piece, score) in order of ids, whether it has all byte pieces) of a sentencepiece file.

    Control and unknown pieces never match text; their places hold unmatchable strings.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    dead = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)
    pieces = [(f"\x00{i}" if dead(i) else sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())]
    names = {p for p, _ in pieces}
    return pieces, all(f"<0x{b:02X}>" in names for b in range(256))


class Counter:
    """Best score and piece count of single words."""

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool):
        import ahocorasick

        self._auto = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece and not piece.startswith("\x00"):
                self._auto.add_word(piece, (len(piece), score))
        self._auto.make_automaton()
        self._unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self._bytes = byte_fallback
        self._reach = max((len(p) for p, _ in pieces), default=1) + 1

    def count(self, word: str, keep: int = 1 << 16) -> tuple[float, int]:
        """(score, pieces) of the marked word; of a long one no more than about ``keep`` ends are held."""
        text = word if word.startswith(MARK) else MARK + word
        # best[i], pieces[i]: of the text up to base + i; unknown[i]: whether it ends in an unknown
        best, pieces, unknown, base = [0.0], [0], [False], 0

        def settle(end: int, top: float, number: int, single: bool) -> None:
            nonlocal base
            odd = False
            if not single:
                value = best[-1] + self._unknown
                if value > top:
                    top, odd = value, True
                    number = pieces[-1] + (len(text[end - 1].encode("utf-8")) if self._bytes else not unknown[-1])
            best.append(top)
            pieces.append(number)
            unknown.append(odd and not self._bytes)
            if len(best) > keep + self._reach:
                for held in (best, pieces, unknown):
                    del held[:keep]
                base += keep

        top, number, single, at = -np.inf, 0, False, 1
        for last, (length, score) in self._auto.iter(text):  # by end, of one end the longest first
            end = last + 1
            while at < end:
                settle(at, top, number, single)
                top, number, single, at = -np.inf, 0, False, at + 1
            start = end - length - base
            value = best[start] + score
            if value > top:
                top, number = value, pieces[start] + 1
            single = single or length == 1
        while at <= len(text):
            settle(at, top, number, single)
            top, number, single, at = -np.inf, 0, False, at + 1
        return best[-1], pieces[-1]


_workers: dict[str, tuple[Counter, dict[bytes, tuple[int, float]]]] = {}


def distinct(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of words that stand for all equal ones, for each word the place of its own in these).

    Words meet by hash and are then told apart by their bytes.
    """
    _, first, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
    n = w.end - w.start
    twin = first[inverse]
    same = n == n[twin]
    for back in (False, True):  # the first and the last eight bytes, which are all of a word of sixteen
        some = lambda k: w.lane(np.maximum(w.end[k] - 8, w.start[k]) if back else w.start[k], np.minimum(n[k], 8))
        same &= some(np.arange(len(n))) == some(twin)
    for i in np.flatnonzero(same & (n > 16) & (twin != np.arange(len(n)))).tolist():
        same[i] = np.array_equal(w.bytes[w.start[i] : w.end[i]], w.bytes[w.start[twin[i]] : w.end[twin[i]]])
    odd = np.flatnonzero(~same)  # a word of another one's hash stands for itself
    inverse = inverse.copy()
    inverse[odd] = len(first) + np.arange(len(odd))
    return np.concatenate([first, odd]), inverse


def token_counts(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", byte_fallback: bool | None = None) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_tokens, best_score.

    Whole texts are read.  Null, empty and blank texts have no words, no tokens and score 0.  Repeated
    rows are counted alike; null ids are kept; a word of any length is one word.  An empty table gives
    an empty result.  Other columns are ignored, whatever their names.  The vocabulary is read on the
    driver and broadcast; a file has a fixed size.
    """
    pieces, whole = read_vocabulary(vocabulary_path)
    fallback = whole if byte_fallback is None else byte_fallback
    shipped = docs.sparkSession.sparkContext.broadcast((pieces, fallback))
    own = only(docs, id_col, text_col).select(F.col(id_col), text_of(text_col).alias("_text"))
    kind = own.schema[0].dataType.simpleString()
    token = hashlib.sha256(repr((pieces, fallback)).encode()).hexdigest()  # what a worker knows is of these pieces only

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a worker keeps what it knows about words from one task to the next
        from weftgraph.llm import token_counts as module

        if token not in module._workers:
            module._workers.clear()
            module._workers[token] = (Counter(*shipped.value), {})
        counter, known = module._workers[token]
        for batch in batches:
            words, tokens, best = [], [], []
            for _, data, offsets in slices(batch.column(1)):
                w = Words(data, offsets, lower=False)
                if len(known) > REMEMBERED:
                    known.clear()
                ones, inverse = distinct(w)
                number, score = np.zeros(len(ones), np.int64), np.zeros(len(ones))
                for i, (a, b) in enumerate(zip(w.start[ones].tolist(), w.end[ones].tolist())):
                    word = data[a:b].tobytes()
                    at = known.get(word)
                    if at is None:
                        s, c = counter.count(word.decode("utf-8"))
                        at = (c, s)
                        if len(word) <= SHORT:
                            known[word] = at
                    number[i], score[i] = at
                sums = np.concatenate([[0], np.cumsum(number[inverse])])
                words.append(np.diff(w.first))
                tokens.append(sums[w.first[1:]] - sums[w.first[:-1]])
                owner = np.repeat(np.arange(len(offsets) - 1), np.diff(w.first))
                best.append(np.bincount(owner, score[inverse], len(offsets) - 1))
            join = lambda x, t: pa.array(np.concatenate(x) if x else np.zeros(0), t)
            yield pa.RecordBatch.from_arrays([batch.column(0), join(words, pa.int64()), join(tokens, pa.int64()), join(best, pa.float64())], names=[id_col, "n_words", "n_tokens", "best_score"])

    return own.mapInArrow(run, f"`{id_col}` {kind}, n_words bigint, n_tokens bigint, best_score double")
