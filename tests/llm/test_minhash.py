import random
import re

import numpy as np
import pyarrow as pa
import pytest

from weftgraph.llm import minhash, wordhash
from weftgraph.llm.minhash import minhash_components


def sets_of(rows, width):
    out = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[i] = frozenset(zip(*(w[j:] for j in range(width)))) if len(w) >= width else frozenset([tuple(w)] if w else [])
    return out


def brute(rows, width, num, den):
    s = sets_of(rows, width)
    root = {i: i for i in s}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(s)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if s[a] and s[b] and den * len(s[a] & s[b]) >= num * len(s[a] | s[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted((i, len(s[i]), find(i), find(i) == i) for i in ids)


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    rows, i = [], 0
    for _ in range(25):
        base = rng.choices(words, k=rng.randrange(3, 160))
        for _ in range(rng.randrange(1, 12)):
            t = list(base)
            for _ in range(rng.randrange(0, 1 + len(t) // 15)):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((i, rng.choice(["{}", "{} ", "\n{}"]).format(" ".join(t).title() if rng.random() < 0.2 else " ".join(t))))
            i += 1
    return rows + [(i, None), (i + 1, ""), (i + 2, " \n"), (i + 3, "One"), (i + 4, "one"), (i + 5, "ÉÉ a"), (i + 6, "éé a"), (i + 7, "long " * 30_000), (i + 8, "long " * 30_001)]


@pytest.mark.parametrize("width, num", [(3, 85), (5, 80)])
def test_components_against_brute_force(docs_of, width, num):
    rows = corpus(width)
    assert sorted(map(tuple, minhash_components(docs_of(rows), width=width, num=num, den=100).collect())) == brute(rows, width, num, 100)


def test_group_that_fills_many_blocks(docs_of):
    """More near copies than a block or a member's partners; most pairs are only linked through others."""
    rng = random.Random(2)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(160):
        t = list(base)
        for _ in range(rng.randrange(0, 5)):
            t[rng.randrange(len(t))] = f"x{rng.random()}"
        rows.append((i, " ".join(t)))
    assert sorted(map(tuple, minhash_components(docs_of(rows), width=3, num=85, den=100, block=16).collect())) == brute(rows, 3, 85, 100)


@pytest.mark.parametrize("seed", range(3))
def test_many_components_in_large_buckets(docs_of, seed):
    """Families around the threshold share buckets, so the second pass has many components to compare."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for f in range(14):
        family = list(base)
        for _ in range(rng.randrange(2, 12)):
            family[rng.randrange(len(family))] = f"f{f}x{rng.random()}"
        for _ in range(rng.randrange(4, 16)):
            t = list(family)
            for _ in range(rng.randrange(0, 5)):
                t[rng.randrange(len(t))] = f"y{rng.random()}"
            rows.append((len(rows), " ".join(t)))
    rng.shuffle(rows)
    want = brute(rows, 3, 85, 100)
    assert len({c for *_, c, _ in want}) > 1
    assert sorted(map(tuple, minhash_components(docs_of(rows), width=3, num=85, den=100, block=8).collect())) == want


def test_null_ids_repeats_and_empty(docs_of):
    rows = [(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, "z y x"), (3, "q")]
    found = {(r["doc_id"], r["component_id"], r["kept"]) for r in minhash_components(docs_of(rows)).collect()}
    assert found == {(1, 1, True), (None, 1, False), (None, None, True), (3, 3, True)}
    assert minhash_components(docs_of(rows).limit(0)).count() == 0


def test_estimates_are_close():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.7, 0.9):
        common, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (int(4000 * share), int(2000 * (1 - share)), int(2000 * (1 - share))))
        sig = minhash.signatures_of([np.unique(np.r_[common, x]) for x in (a, b)], 1024)
        equal = (sig[0] == sig[1]).mean()
        estimate = (equal - minhash.CHANCE) / (1 - minhash.CHANCE)
        exact = len(common) / (len(common) + len(a) + len(b))
        assert abs(estimate - exact) < 0.06


def test_bit_counts_equal_byte_counts():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 4, (7, 16), dtype=np.uint8), rng.integers(0, 4, (5, 16), dtype=np.uint8)
    lanes = [np.ascontiguousarray(x).view(np.uint64) for x in (a, b)]
    assert (minhash._equal_bytes(*lanes) == (a[:, None, :] == b[None, :, :]).sum(axis=2)).all()


def test_shingle_sets_have_the_right_sizes():
    rows = corpus(9)
    sizes = [len(s) for s in wordhash.shingle_sets(pa.array([t or "" for _, t in rows]), 3)]
    assert sizes == [len(s) for s in sets_of(rows, 3).values()]
    assert list(wordhash.shingle_sets(pa.array([], pa.string()), 3)) == []
