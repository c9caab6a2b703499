"""Words of regular patterns, which weak hashes of strings confuse, in all that is built on word hashes."""

import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from test_minhash import brute

import corpus_pipeline as cp
from weftgraph.llm import toxicity as tox
from weftgraph.llm import wordhash
from weftgraph.llm.minhash import minhash_components
from weftgraph.llm.token_counts import Counter, distinct, read_vocabulary, token_counts


def thue_morse(n, a="t", b="h"):
    """n letters of a sequence whose halves, quarters and so on are each other's opposites."""
    return "".join(b if i.bit_count() % 2 else a for i in range(n))


def patterned(seed):
    """Pairs of different words of equal length and regular build."""
    rng = random.Random(seed)
    n = rng.choice([1024, 2048, 4096, 1024 * rng.randrange(1, 65), 65_536])
    a, b = rng.sample("abthxyz", 2)
    return thue_morse(n, a, b), thue_morse(n, b, a)


def words_of(texts, **more):
    return [wordhash.Words(data, offsets, **more) for _, data, offsets in wordhash.slices(pa.array(texts))]


@pytest.mark.parametrize("seed", range(6))
def test_patterned_words_differ(seed):
    x, y = patterned(seed)
    for more in ({}, {"seed": 1}, {"window": 1000}):
        (w,) = words_of([f"{x} {y} {x}"], **more)
        assert w.hash[0] == w.hash[2] != w.hash[1]
    for width in (3, 5):
        s, t, u = wordhash.shingle_sets(pa.array([x, y, x]), width)
        assert (s == u).all() and not (s == t).any()


def test_short_words_of_all_lengths_differ():
    rng = random.Random(0)
    texts = list({"".join(rng.choice("ab") for _ in range(rng.randrange(1, 80))) for _ in range(4000)} | {"a" * n for n in range(1, 200)})
    for seed in (0, 1):
        (w,) = words_of([" ".join(texts)], seed=seed)
        assert len(set(w.hash.tolist())) == len(texts)
    zero, one = (words_of([" ".join(texts)], seed=s)[0].hash for s in (0, 1))
    assert abs(np.bitwise_count(zero ^ one).mean() - 32) < 1


def test_digests_are_of_words_in_order():
    texts = ["a b c", " A  b\nc ", "ab c", "a bc", "c b a", "", " ", "a", "b" * 300 + " a"]
    got = [d for w in words_of(texts) for d in w.digests()]
    assert got[0] == got[1] and got[5] == got[6] and len(set(got)) == len(texts) - 2
    joined = wordhash.Words(np.frombuffer(b"abcd ef", np.uint8), np.array([0, 2, 7]))  # no space between two texts
    assert list(joined.digests()) == [d for w in words_of(["ab", "cd ef"]) for d in w.digests()]


def test_equal_hashes_are_told_apart():
    (w,) = words_of(["ab cd ab " + "x" * 20 + " " + "x" * 19 + "y ab " + "x" * 20], lower=False)
    w.hash = np.zeros(len(w.hash), np.uint64)
    ones, inverse = distinct(w)
    spell = lambda i: w.bytes[w.start[i] : w.end[i]].tobytes()
    assert [spell(ones[i]) for i in inverse] == [spell(i) for i in range(len(w.start))]


def test_near_dedup_tells_patterned_words_apart(docs_of):
    rows = [(0, thue_morse(1024)), (1, thue_morse(1024, "h", "t")), (2, "one two " + thue_morse(2048) + " four five"), (3, "one two " + thue_morse(2048, "h", "t") + " four five"), (4, thue_morse(1024))]
    assert sorted(map(tuple, minhash_components(docs_of(rows), width=3, num=85, den=100).collect())) == brute(rows, 3, 85, 100)


def test_the_pipeline_keeps_patterned_words(docs_of, spark):
    rows = [(i, f"one two {x} four five") for i, x in enumerate([thue_morse(1024), thue_morse(1024, "h", "t")])]
    assert sorted(r["doc_id"] for r in cp.drop_near_copies(spark, docs_of(rows), "").collect()) == [0, 1]


def test_token_counts_of_patterned_words(docs_of):
    path = str(P.path("piece_bpe_32k.model"))
    counter = Counter(*read_vocabulary(path))
    rows = [(0, thue_morse(1024)), (1, thue_morse(1024, "h", "t")), (2, thue_morse(1024)), (3, f"{thue_morse(4096, 'h', 't')} {thue_morse(4096)}")]
    for order in (rows, rows[::-1]):
        got = {r["doc_id"]: r["n_tokens"] for r in token_counts(docs_of(order), path).collect()}
        assert got == {i: sum(counter.count(w)[1] for w in t.split()) for i, t in rows}


def test_features_of_patterned_words():
    data, offsets = [(d, o) for _, d, o in wordhash.slices(pa.array([thue_morse(1024) + "t", thue_morse(1024, "h", "t") + "t"]))][0]
    owner, ids = tox.features(data, offsets)
    assert set(ids[owner == 0]) != set(ids[owner == 1]) and len(set(ids.tolist())) == 2 * (1 + len(tox.STEMS))


def test_the_sample_is_bounded_in_bytes(docs_of, spark):
    rng = random.Random(1)
    docs = docs_of([(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(300))) for i in range(60)])
    labels = spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(60)], "doc_id long, quality int, toxic int")
    found = tox.labelled_rows(docs, tox.chain_labels(labels), "doc_id", "text", 50)
    sizes = {r["_weft_h"]: len(r["_weft_features"]) for r in found.collect()}
    kept = [r["_weft_h"] for r in tox.bounded(found, 20_000).collect()]
    assert 0 < len(kept) < 50 and sum(sizes[h] for h in kept) <= 20_000 and sorted(kept) == sorted(sizes)[: len(kept)]
    assert tox.train(docs, tox.chain_labels(labels), "toxic", max_bytes=20_000).held.shape == (len(kept), 2)
    assert tox.toxicity(docs, labels).count() == 60
