import hashlib
import re

import numpy as np
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftgraph.llm import cqf
from weftgraph.llm.exact_dedup import drop_exact_duplicates, exact_dedup

ROWS = [(1, "a  b"), (7, "a b"), (2, "a\tb"), (3, None), (4, ""), (5, "q"), (6, " a b"), (8, "x" * 200_000), (9, "x" * 200_000), (10, "a\x0b\x0cb"), (11, "a b")]


def brute(rows):
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in rows}
    groups = {}
    for i, t in norm.items():
        groups.setdefault(t, []).append(i)
    return sorted((i, min(groups[t]), len(groups[t]), i == min(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in norm.items())


def test_groups_against_brute_force(docs_of):
    assert sorted(map(tuple, exact_dedup(docs_of(ROWS)).collect())) == brute(ROWS)


def test_equal_fingerprints_of_different_texts_part(docs_of):
    found = exact_dedup(docs_of(ROWS), fingerprint=lambda c: F.length(c).cast("long") % 2)
    assert sorted(map(tuple, found.collect())) == brute(ROWS)


def test_nulls_repeats_and_empty(docs_of):
    rows = [(1, "a"), (1, "a"), (1, "b"), (None, "a"), (None, "c"), (2, "a")]
    found = exact_dedup(docs_of(rows)).collect()
    assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in found} == {(1, 1, True), (None, 1, False), (None, None, True), (2, 1, False)}
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["text"]) for r in drop_exact_duplicates(docs_of(rows)).collect()) == [((False, 1), "a"), ((False, 1), "b"), ((True, 0), "c")]
    assert exact_dedup(docs_of(rows).limit(0)).count() == 0 and drop_exact_duplicates(docs_of(rows).limit(0)).count() == 0


def test_hot_text(docs_of, spark):
    df = docs_of([(0, "t")]).limit(0).unionByName(spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("same").alias("text")).crossJoin(docs_of([(0, "t")]).drop("doc_id", "text")))
    assert exact_dedup(df).where("kept").collect()[0]["group_size"] == 3000


@given(st.lists(st.integers(0, 2**16 - 1), max_size=200), st.lists(st.integers(0, 2**16 - 1), max_size=200))
def test_filters_merge_without_loss(a, b):
    blobs = [cqf.build(np.array(x, np.uint64), None, 16) for x in (a, b)]
    values, counts = cqf.decode(cqf.merge(blobs, 16))
    expected = np.unique(np.array(a + b, np.uint64), return_counts=True)
    assert values.tolist() == expected[0].tolist() and counts.tolist() == expected[1].tolist()


def test_filter_of_whole_fingerprints():
    x = np.array([2**64 - 1, 0, 2**63, 2**64 - 1], np.uint64)
    values, counts = cqf.decode(cqf.build(x, None, 64))
    assert values.tolist() == [0, 2**63, 2**64 - 1] and counts.tolist() == [1, 1, 2]


def test_ids_are_dropped(docs_of, spark):
    from weftgraph.llm.exact_dedup import drop_ids

    docs, gone = docs_of([(1, "a"), (2, "b"), (None, "c"), (3, None), (3, "d")]), spark.createDataFrame([(3,), (None,), (9,), (3,)], "g long")
    out = drop_ids(docs, gone)
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == [1, 2]
    assert drop_ids(docs, gone.limit(0)).count() == 5
