"""A byte-level BPE vocabulary file as an encoder.

The file is read on the driver and shipped, so executors need the libraries only.  Where the file is a
plain byte-level BPE whose ids follow the merge order, texts go through the faster of the two public
implementations of that algorithm; any other file, and texts that hold one of its special strings, go
through ``tokenizers`` itself.  Tests hold both to the same ids.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass
from pathlib import Path

import numpy as np

#: Fixed value: the published pre-tokenisation pattern of this family of vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_of() -> dict[str, int]:
    """The published printable stand-ins for bytes: printable ones are themselves, the rest follow from U+0100 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass(frozen=True)
class Parts:
    """What a worker needs: the file, and where the faster encoder may be used its ranks and what it can't take."""

    key: str
    spec: str
    ranks: dict[bytes, int] | None
    special: tuple[str, ...]


def read_parts(path: str) -> Parts:
    """Read and parse a vocabulary file once, on the driver."""
    return parts_of(Path(path).read_text(encoding="utf-8"))


def parts_of(spec: str) -> Parts:
    d = json.loads(spec)
    special = tuple(t["content"] for t in d.get("added_tokens") or [])
    return Parts(hashlib.sha256(spec.encode()).hexdigest(), spec, _ranks(d, set(special)), special)


def _ranks(d: dict, special: set[str]) -> dict[bytes, int] | None:
    """Bytes of each piece and its rank, or None unless the file is a plain byte-level BPE in merge order."""
    model, pre = d["model"], d.get("pre_tokenizer") or {}
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model.get("merges") or []]
    plain = model.get("type", "BPE") == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    plain = plain and not d.get("normalizer") and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    vocab = model["vocab"]
    if not plain or any(a + b not in vocab for a, b in merges):
        return None
    order = [vocab[a + b] for a, b in merges]
    if order != sorted(set(order)) or len(order) + 256 + len(special & vocab.keys()) != len(vocab):
        return None
    byte_of = _byte_of()
    return {bytes(byte_of[c] for c in w): i for w, i in vocab.items() if w not in special}


class Encoder:
    def __init__(self, parts: Parts):
        self._parts, self._fast, self._plain = parts, None, None
        if parts.ranks is not None:
            import tiktoken

            self._fast = tiktoken.Encoding(parts.key, pat_str=PATTERN, mergeable_ranks=parts.ranks, special_tokens={})

    def plain_ids(self, text: str) -> np.ndarray:
        """The ids by the library that the file is written for; it is loaded at the first call."""
        if self._plain is None:
            import tokenizers

            self._plain = tokenizers.Tokenizer.from_str(self._parts.spec)
        return np.array(self._plain.encode(text, add_special_tokens=False).ids, "<u4")

    def ids(self, text: str) -> np.ndarray:
        """The ids of a whole text, without special tokens around it.

        The faster implementation's pattern matcher gives up on runs of about a million white-space
        characters; such a text goes the other way, which has the same ids.
        """
        if self._fast is not None and not any(s in text for s in self._parts.special):
            try:
                return self._fast.encode_to_numpy(text).astype("<u4", copy=False)
            except ValueError:
                pass
        return self.plain_ids(text)


_worker: dict[str, Encoder] = {}


def encoder_of(parts: Parts) -> Encoder:
    """The encoder of a file; a worker keeps the last one from task to task."""
    from weftgraph.llm import tokenizer as module

    if parts.key not in module._worker:
        module._worker.clear()
        module._worker[parts.key] = Encoder(parts)
    return module._worker[parts.key]
