import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import vector_codes as vc


def brute(rows, parts, entries, rounds, scale=256):
    kept = [(i, v, l) for i, v, l in rows if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)]
    kept = sorted(kept, key=lambda r: (r[0] is None, r[0], r[1]))
    x = np.array([[int(np.floor(np.float64(np.float32(c)) * scale)) for c in v] for _, v, _ in kept]).reshape(len(kept), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()

    def assign():
        d = ((x[:, :, None, :] - books[None]) ** 2).sum(axis=3)
        return d.argmin(axis=2), d.min(axis=2)

    for _ in range(rounds):
        at, _ = assign()
        for p in range(parts):
            for e in range(books.shape[1]):
                mine = x[at[:, p] == e, p]
                if len(mine):
                    books[p, e] = mine.sum(axis=0) // len(mine)
    at, d = assign()
    errors = d.sum(axis=1)
    label = {}
    for (_, _, l), e in zip(kept, errors):
        label[l] = label.get(l, 0) + int(e)
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    return sorted(((i, "".join(f"{c:02x}" for c in a), int(e), label[l], digest) for (i, _, l), a, e in zip(kept, at, errors)), key=repr)


def table(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return df.withColumns({c: F.lit(1) for c in ("code", "error", "label_error", "slot", "_weft_label")})


@pytest.mark.parametrize("seed", range(3))
def test_codes_are_those_of_a_full_search(spark, seed):
    rng = np.random.default_rng(seed)
    grid = seed == 1  # coarse values make many ties and equal entries
    vec = lambda: [float(x) for x in (rng.integers(-2, 3, 32) / 256 if grid else rng.normal(size=32).astype(np.float32))]
    rows = [(i, vec(), int(rng.integers(4)) if rng.random() < 0.8 else None) for i in range(300)]
    rows += [(400, None, 1), (401, [float("nan")] * 32, 1), (402, [None] * 32, 1), (403, [float("inf"), *[0.0] * 31], 2), (404, [], 2), (405, [1.0] * 31, 2), (406, [1.0] * 48, None)]
    rows += [rows[7], (None, vec(), 1)]
    rng.shuffle(order := np.arange(len(rows)))
    got = vc.vector_codes(table(spark, [rows[i] for i in order]), parts=16, entries=64, rounds=2).collect()
    want = brute([r for r in rows if r[0] not in (405, 406)], 16, 64, 2)
    assert sorted(map(tuple, got), key=repr) == want


def test_few_rows_no_rows_and_large_values(spark):
    rows = [(1, [0.5] * 16, None), (0, [-0.001] * 16, None)]
    assert sorted(map(tuple, vc.vector_codes(table(spark, rows)).collect()), key=repr) == brute(rows, 16, 64, 2)
    assert vc.vector_codes(table(spark, rows).limit(0)).collect() == []
    with pytest.raises(Exception, match="too large"):
        vc.vector_codes(table(spark, [(0, [1e30] * 16, 1)])).collect()


@pytest.mark.parametrize("width, spread", [(1, 5), (4, 3), (4, 1000), (8, 100_000)])
def test_search_is_exact_and_prunes(width, spread):
    rng = np.random.default_rng(width * spread)
    book = rng.integers(-spread, spread + 1, (64, width))
    near = book[rng.integers(0, 64, 4000)] + rng.integers(-1 - spread // 50, 2 + spread // 50, (4000, width))
    search, met = vc.Search(book), []
    plain = search._meet
    search._meet = lambda e, rows: (met.append(len(rows)), plain(e, rows))[1]
    entry, best = search.nearest(near)
    d = ((near[:, None] - book[None]) ** 2).sum(axis=2)
    assert (best == d.min(axis=1)).all() and (entry == d.argmin(axis=1)).all()
    if spread >= 1000:
        assert sum(met) < 0.6 * 64 * len(near)
