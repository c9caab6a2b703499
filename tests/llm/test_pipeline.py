"""The corpus pipeline against plain Python, stage by stage, and on odd rows."""

import hashlib
import re
from collections import Counter as Count

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_minhash import brute as near_groups
from test_models_and_files import BPE, ODD, plain_features
from test_native import tree_budgets
from tokenizers import Tokenizer

import corpus_pipeline as cp
from weftgraph.llm import exact_dedup, mixing
from weftgraph.llm import toxicity as tox
from weftgraph.llm.queries import DOMAINS, WEIGHTS

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.collect()]


def kept(stage, spark, docs):
    out = stage(spark, docs, SF)
    assert out.columns == docs.columns
    found = Count((r["doc_id"], r["text"]) for r in out.collect())
    assert found.total() == len(found)
    return sorted(i for i, _ in found)


def test_toxic_rows_go_by_the_fitted_weights(spark, docs, rows):
    chain = tox.train(docs, tox.chain_labels(spark.read.parquet(f"{SF}/labels.parquet")), "toxic")
    weights = [dict(zip(m.ids.tolist(), m.weights.astype(np.float32).tolist())) for m in chain.models]

    def last(text):
        p, ids = [], plain_features(text)
        for m, w in zip(chain.models, weights):
            z = sum(w.get(i, 0.0) for i in ids) + sum(a * b for a, b in zip(p, m.earlier)) + m.bias
            p.append(1 / (1 + np.exp(-z)))
        return p[-1]

    want = sorted(i for i, t, *_ in rows if last(t) < chain.threshold)
    assert 0 < len(want) < len(rows) and kept(cp.drop_toxic, spark, docs) == want


def test_copies_go(spark, docs, rows):
    first = {}
    for i, t, *_ in sorted(rows):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), i)
    assert kept(cp.drop_copies, spark, docs) == sorted(first.values()) and len(first) < len(rows)


def test_near_copies_go(spark, docs, rows):
    want = sorted(i for i, _, _, keep in near_groups([r[:2] for r in rows], 5, 80, 100) if keep)
    assert kept(cp.drop_near_copies, spark, docs) == want and len(want) < len(rows)


def plain_mix(rows):
    """Ids that the mix reads: by leaf, in the order of the epoch's hash, until the budget is used up."""
    domain = {s: d for d, sources in DOMAINS.items() for s in sources}
    leaves = {}
    for i, t, lang, source in rows:
        leaves.setdefault((domain.get(source, "other"), lang or "", source or ""), []).append((i, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))))
    tokens = {k: sum(n for _, n in v) for k, v in leaves.items()}
    budget = tree_budgets(tokens, WEIGHTS, 1, sum(tokens.values()) * 3 // 4)
    out = []
    for k, v in leaves.items():
        whole, start = (budget[k] // tokens[k] if tokens[k] else 0), 0
        if whole:
            out += [i for i, n in v if n]
            continue
        for _, i, n in sorted((int(hashlib.md5(f"{cp.MIX['seed']}:{whole}:{i}".encode()).hexdigest()[:12], 16), i, n) for i, n in v):
            out += [i] if n and start < budget[k] else []
            start += n
    return sorted(out)


def test_the_mix_reads_its_rows(spark, docs, rows, monkeypatch):
    want = plain_mix(rows)
    assert len(want) < len(rows) and kept(cp.mix, spark, docs) == want
    monkeypatch.setattr(mixing, "LEAVES", 0)  # as with more leaves than are broadcast
    assert kept(cp.mix, spark, docs) == want


def test_more_ids_than_are_broadcast(spark, docs, monkeypatch):
    few = [kept(stage, spark, docs) for stage in (cp.drop_copies, cp.drop_near_copies)]
    monkeypatch.setattr(exact_dedup, "FEW", 0)
    assert [kept(stage, spark, docs) for stage in (cp.drop_copies, cp.drop_near_copies)] == few


def test_packed_rows_are_the_tokens(spark, docs, rows):
    t = Tokenizer.from_file(BPE)
    length = {i: len(t.encode(x or "", add_special_tokens=False).ids) + 1 for i, x, *_ in rows}
    found = cp.pack(spark, docs, SF)
    assert {r["doc_id"]: r["n"] for r in found.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == length
    assert found.select("sequence_id").distinct().count() == -(-sum(length.values()) // 2048)


def test_the_whole_pipeline(spark, docs):
    left = docs
    for _, stage in cp.STAGES:
        left = cp.stored(stage(spark, left, SF), "test")
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert cp.run(spark, SF).select(names[:5]).exceptAll(left.select(names[:5])).count() == 0


def test_stages_take_odd_documents(docs_of, spark):
    docs = docs_of([(i, x) for i, x in enumerate(ODD)] + [(None, "n"), (3, "again"), (3, "again"), (90, " " * 1_000_000), (91, "\n" * 1_000_000 + "x")])
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and stage(spark, docs.limit(0), SF).count() == 0
        docs = spark.createDataFrame(out.collect(), docs.schema)
    assert cp.STAGES[-1][1](spark, docs, SF).count() > 0 and cp.STAGES[-1][1](spark, docs.limit(0), SF).count() == 0


def test_a_verdict_drops_its_own_row_only(docs_of, spark):
    made = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    verdict = {r["doc_id"]: r["kept"] for r in tox.toxicity(made, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    text = {r["doc_id"]: r["text"] for r in made.collect()}
    bad, good = ([text[i] for i in sorted(text) if verdict[i] == k and len(text[i]) > 200] for k in (False, True))
    rest = [(i, text[i]) for i in sorted(text)]
    docs = docs_of(rest + [(None, bad[0]), (None, good[0]), (900_000, bad[1]), (900_000, good[1])])
    left = Count((r["doc_id"], r["text"]) for r in cp.drop_toxic(spark, docs, SF).select("doc_id", "text").collect())
    assert left == Count([(i, t) for i, t in rest if verdict[i]] + [(None, good[0]), (900_000, good[1])])

    words = " ".join(f"w{i}" for i in range(100))
    rows = [(1, words), (7, words + " more"), (7, "something else by far"), (None, words + " yet more"), (None, "and one other clean text")]
    out = cp.drop_near_copies(spark, docs_of(rows), SF)
    assert Count((r["doc_id"], r["text"]) for r in out.collect()) == Count([rows[0], rows[2], rows[4]])
    assert out.columns == docs.columns

    # blank rows are never read by the mix; three in four of the other tokens are
    rows = [(None, ""), (5, " ")] + [(i, "a b c d") for i in (None, None, 5, 5, 6, 7, 8, 9)]
    taken = Count(r["text"] for r in cp.mix(spark, docs_of(rows), SF).collect())
    assert taken == {"a b c d": 6}
