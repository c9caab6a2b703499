"""Toxicity, token counts, packing, WARC and the pipeline."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter as Count

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

from weftgraph.llm import toxicity as tox
from weftgraph.llm import warc
from weftgraph.llm.binpack import best_plan, pack_counts, slots
from weftgraph.llm.packing import pack_documents, sequences
from weftgraph.llm.token_counts import MARK, Counter, read_vocabulary, token_counts
from weftgraph.llm.tokenizer import Encoder, read_parts

BPE = str(P.path("byte_bpe_50k.json"))
ODD = [None, "", " ", "\n\n", "a", "é😀  x\x00y", "don't  STOP\r\n", "<|endoftext|> x", "z" * 5000, "word " * 6000]

# ---- toxicity


def toxic_rows(seed, n):
    rng = random.Random(seed)
    clean = [f"{a}{b}" for a in ("sun", "tree", "road", "lake") for b in ("ing", "ed", "s", "er", "ly")]
    rows = []
    for i in range(n):
        bad = i % 8 == 0
        words = rng.choices(clean, k=rng.randrange(12, 60))
        for _ in range(3 if bad else 0):
            words[rng.randrange(len(words))] = rng.choice(["grobian", "grobians", "lumpkin"]) + rng.choice(["", "xx", "!"])
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_chain_on_held_out_documents(docs_of, spark):
    rows = toxic_rows(1, 1600)
    labels = spark.createDataFrame([(i, 1, t) for i, _, t in rows if i < 800], "doc_id long, quality int, toxic int")
    found = {r["doc_id"]: r for r in tox.toxicity(docs_of([(i, x) for i, x, _ in rows] + [(None, "a"), (9000, None), (9001, "")]), labels).collect()}
    held = [(found[i]["toxic"], bool(t)) for i, _, t in rows if i >= 800]
    assert sum(a == b for a, b in held) / len(held) > 0.98
    assert found[9000]["kept"] and found[9001]["kept"] and found[None]["kept"]
    assert all(r["kept"] != r["toxic"] for r in found.values())


def test_no_labels_reject_nothing(docs_of, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = docs_of([(1, "a"), (2, None)])
    assert all(r["kept"] for r in tox.toxicity(docs, none).collect())
    some = spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert all(r["kept"] for r in tox.toxicity(docs, some).collect())
    assert tox.toxicity(docs.limit(0), some).count() == 0


def test_later_models_get_out_of_fold_probabilities():
    rng = np.random.default_rng(0)
    n = 400
    first = rng.random(n) < 0.5
    rows = [np.array([1, 2] if a else [3, 4], np.int32) for a in first]
    labels = np.stack([first, first], axis=1)
    models_, held = tox.fit_chain(tox.Sample.of(rows), labels, np.arange(n) % 5)
    assert len(models_[0].earlier) == 0 and len(models_[1].earlier) == 1 and models_[1].earlier[0] > 0
    assert ((held > 0.5) == labels).all()


def test_sample_is_bounded(docs_of, spark):
    rows = toxic_rows(2, 60)
    labels = spark.createDataFrame([(i, 1, t) for i, _, t in rows] * 2, "doc_id long, quality int, toxic int")
    docs = docs_of([(i, x) for i, x, _ in rows] * 2)
    assert tox.labelled_rows(docs, tox.chain_labels(labels), "doc_id", "text", 20).count() == 20


def plain_features(text):
    """Feature ids of a text, byte by byte."""
    out, whole = set(), (1 << 64) - 1

    def final(x):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = ((x ^ (x >> shift)) * factor) & whole
        return x ^ (x >> 31)

    def word_hash(w):
        if len(w) > 64:
            return int.from_bytes(hashlib.blake2b(w, digest_size=8, salt=bytes(8)).digest(), "little")
        state = final((len(w) * 0xA0761D6478BD642F + 0xD1B54A32D192ED03) & whole)
        state = final(state ^ int.from_bytes(w[:8], "little"))
        for at in range(8, len(w), 8):
            state = final(((state ^ int.from_bytes(w[at : at + 8], "little")) * 0xE7037ED1A0B428DB) & whole)
        return state

    for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode()):
        w = w.lower()  # bytes: A-Z only
        for part in [w, *(w[:n] for n in (4, 5, 6, 8) if len(w) > n)]:
            out.add(word_hash(part) >> 44)
    return out


def test_scores_are_those_of_the_fitted_weights(docs_of, spark):
    """Each row's probabilities, worked out again text by text from the models; also of odd texts and rows."""
    rows = toxic_rows(3, 240)
    texts = [(i, x) for i, x, _ in rows] + [(1000 + i, x) for i, x in enumerate(ODD)] + [(None, "grobian lumpkin " * 9), (7, "grobians"), (7, "grobians")]
    labels = spark.createDataFrame([(i, i % 3 > 0, t) for i, _, t in rows], "doc_id long, quality boolean, toxic int").selectExpr("doc_id", "cast(quality as int) quality", "toxic")
    docs = docs_of(texts)
    chain = tox.train(docs, tox.chain_labels(labels), "toxic")
    weights = [dict(zip(m.ids.tolist(), m.weights.astype(np.float32).tolist())) for m in chain.models]

    def brute(text):
        p, ids = [], plain_features(text)
        for m, w in zip(chain.models, weights):
            z = sum(w.get(i, 0.0) for i in ids) + sum(a * b for a, b in zip(p, m.earlier)) + m.bias
            p.append(1 / (1 + np.exp(-z)))
        return p

    found = sorted(((r["doc_id"] is None, r["doc_id"], r["p_junk"], r["p_toxic"], r["kept"]) for r in tox.score(docs, chain).collect()), key=repr)
    want = sorted(((i is None, i, *brute(x)) for i, x in texts), key=repr)
    by_id = {}
    for none, i, *p in want:
        by_id.setdefault(i, []).append(p)
    assert len(found) == len(want)
    for none, i, *p, kept in found:
        assert any(np.allclose(p, q, rtol=1e-4, atol=1e-7) for q in by_id[i])
        assert kept == (p[-1] < chain.threshold)
    assert 0 < sum(not r[-1] for r in found) < len(found)
    # the filter keeps just these rows, whole
    left = tox.without_rejected(docs, chain)
    assert left.schema == docs.schema
    assert Count((r["doc_id"], r["text"]) for r in left.collect()) == Count((i, x) for i, x in texts if brute(x)[-1] < chain.threshold)


def test_any_kind_of_id_and_label_name(spark):
    rows = toxic_rows(4, 80)
    docs = spark.createDataFrame([(f"d{i}", x, 1) for i, x, _ in rows], "key string, body string, features int")
    labels = spark.createDataFrame([(f"d{i}", i % 2, t) for i, _, t in rows], "key string, features int, bad int")
    chain = tox.train(docs, labels, "bad", "key", "body")
    found = tox.score(docs, chain, "key", "body")
    assert found.columns == ["key", "p_features", "p_bad", "bad", "kept"] and found.count() == 80


def test_words_do_not_depend_on_windows():
    import pyarrow as pa

    from weftgraph.llm import wordhash

    rng = random.Random(5)
    texts = ["".join(rng.choice("ab c\té \n") for _ in range(rng.randrange(60))) for _ in range(200)] + ["z" * 300, "", " "]
    for _, data, offsets in wordhash.slices(pa.array(texts)):
        whole = wordhash.Words(data, offsets)
        for window in (1, 2, 7, 64):
            part = wordhash.Words(data, offsets, window=window)
            for name in ("start", "end", "first", "hash"):
                assert (getattr(part, name) == getattr(whole, name)).all()
        assert (whole.hash[whole.end - whole.start == 3] == whole.beginning_hash(whole.start[whole.end - whole.start == 3], 3)).all()


# ---- token counts


@pytest.fixture(scope="module")
def unigram():
    return read_vocabulary(str(P.path("piece_bpe_32k.model")))


def library(vocabulary, fallback):
    t = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=fallback))
    t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(r"[\x20\x09-\x0D]+"), "removed"), pre_tokenizers.Metaspace(replacement=MARK, prepend_scheme="always", split=False)])
    return t


@pytest.mark.parametrize("fallback", [True, False])
def test_counts_equal_the_library(unigram, fallback):
    pieces = unigram[0]
    if not fallback:
        pieces = pieces[:700]  # many characters are unknown then
    t, c = library(pieces, fallback), Counter(pieces, fallback)
    rng = random.Random(1)
    for _ in range(400):
        x = "".join(rng.choice("aébcth ▁а中\U0001f600ñ<0xA>\n ") for _ in range(50))
        assert sum(c.count(w)[1] for w in re.findall(r"[^\x20\x09-\x0D]+", x)) == len(t.encode(x, add_special_tokens=False).ids)


def test_ties_go_to_the_earlier_start():
    pieces = [("<unk>", 0.0), ("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁a", -2.0), ("▁ab", -3.0), ("c", -1.5)]
    t, c = library(pieces, False), Counter(pieces, False)
    for w in ("a", "ab", "abab", "abcab", "xxab", "xyz", "axb"):
        assert c.count(w)[1] == len(t.encode(w, add_special_tokens=False).ids)


@pytest.mark.parametrize("fallback", [True, False])
def test_long_words_hold_few_ends(unigram, fallback):
    pieces = unigram[0] if fallback else unigram[0][:700]
    t, c = library(pieces, fallback), Counter(pieces, fallback)
    rng = random.Random(2)
    for _ in range(20):
        w = "".join(rng.choice("aébcthing中\U0001f600ñ") for _ in range(600))
        assert c.count(w, keep=7) == c.count(w) and c.count(w)[1] == len(t.encode(w, add_special_tokens=False).ids)


def test_token_count_rows(docs_of, unigram):
    rows = list(enumerate(ODD))
    t = library(*unigram)
    found = {r["doc_id"]: r for r in token_counts(docs_of(rows), str(P.path("piece_bpe_32k.model"))).collect()}
    for i, x in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", x or "")
        assert found[i]["n_words"] == len(words)
        assert found[i]["n_tokens"] == sum(len(t.encode(w, add_special_tokens=False).ids) for w in words)
    assert token_counts(docs_of(rows).limit(0), str(P.path("piece_bpe_32k.model"))).count() == 0


# ---- packing


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=80))
def test_encoder_equals_the_library(text):
    e = _encoder()
    assert e.ids(text).tolist() == e.plain_ids(text).tolist()


_kept = []


def _encoder():
    if not _kept:
        _kept.append(Encoder(read_parts(BPE)))
    return _kept[0]


def test_packing_is_a_gapless_round_trip(docs_of):
    rows = list(enumerate(ODD)) + [(100 + i, "some words " * (i * 7 % 90)) for i in range(150)] + [(None, "x y"), (5, "again")]
    found = pack_documents(docs_of(rows), BPE, capacity=64, end_id=0, with_ids=True).cache()
    got = found.collect()
    t = Tokenizer.from_file(BPE)
    want = Count(tuple(t.encode(x or "", add_special_tokens=False).ids + [0]) for _, x in rows)
    by_seq, docs = {}, {}
    for r in got:
        by_seq.setdefault(r["sequence_id"], []).append(r)
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]
        assert r["piece"] == 0 or r["length"] == 64
        docs.setdefault(r["doc_id"], []).append(r)
    whole = Count()
    for i, rs in docs.items():
        if i in (5, None):
            continue
        rs.sort(key=lambda r: r["piece"])
        assert [r["start"] for r in rs] == np.cumsum([0, *(r["length"] for r in rs[:-1])]).tolist()
        whole[tuple(x for r in rs for x in r["ids"])] += 1
    assert sum((want - whole).values()) == 3  # the two rows of id 5 and the one without an id
    for rs in by_seq.values():
        rs.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in rs] == np.cumsum([0, *(r["length"] for r in rs[:-1])]).tolist()
        assert sum(r["length"] for r in rs) <= 64
    assert {r["sequence_id"]: len(r["ids"]) for r in sequences(found).collect()} == {k: sum(r["length"] for r in v) for k, v in by_seq.items()}
    assert pack_documents(docs_of(rows).limit(0), BPE).count() == 0


def test_long_runs_of_space_are_tokenised(docs_of):
    """The faster encoder fails on these; ids are those of the library all the same."""
    rows = [(0, " " * 1_000_000), (1, "\n" * 1_000_000), (2, "\t" * 1_000_000), (3, "a" + " \n" * 600_000 + "b"), (4, "z" * 400_000)]
    t = Tokenizer.from_file(BPE)
    found = pack_documents(docs_of(rows), BPE, with_ids=True).collect()
    for i, x in rows:
        ids = [v for r in sorted((r for r in found if r["doc_id"] == i), key=lambda r: r["piece"]) for v in r["ids"]]
        assert ids == t.encode(x, add_special_tokens=False).ids + [0]


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.integers(0, 60), max_size=30))
def test_plans_place_every_item_once(counts):
    for plan, placed in (pack_counts(counts, 100, 5), pack_counts(counts, 100, 3, small=1.0), pack_counts(counts, 100, 40, 0.1), best_plan(counts, 100, ((4, 0.3), (9, 0.5)))):
        assert all(n > 0 and 0 < sum(x) <= 100 for x, n in plan)
        got = Count()
        for x, n in plan:
            for v in x:
                got[v] += n
        assert got == Count({k: v for k, v in counts.items() if v})
        assert 0 <= placed <= sum(n for x, n in counts.items() if x < 100)
        keys, firsts, offsets = slots(plan, 100)
        assert len(keys) == sum(len(x) for x, _ in plan) and (np.diff(keys) > 0).all()


def best_fit_bins(lengths, capacity):
    """Plain best fit of decreasing lengths, one item at a time."""
    import bisect

    rooms: list[int] = []
    for x in sorted(lengths, reverse=True):
        i = bisect.bisect_left(rooms, x)
        room = rooms.pop(i) if i < len(rooms) else capacity
        bisect.insort(rooms, room - x)
    return len(rooms)


FAMILIES = {
    "log-normal": lambda rng, n: rng.lognormal(6.6, 0.9, n),
    "uniform": lambda rng, n: rng.integers(1, 2049, n),
    "clustered": lambda rng, n: rng.normal(700, 60, n),
}


@pytest.mark.parametrize("name", FAMILIES)
def test_plans_beat_plain_best_fit(name):
    lengths = np.clip(FAMILIES[name](np.random.default_rng(1), 20_000).astype(int), 1, 2048)
    counts = {int(k): int(v) for k, v in zip(*np.unique(lengths, return_counts=True))}
    plan, placed = best_plan(counts, 2048)
    assert sum(n for _, n in plan) <= best_fit_bins(lengths.tolist(), 2048)
    assert placed > 0.95 * sum(n for x, n in counts.items() if 1024 < x < 2048)
    with pytest.raises(ValueError):
        pack_counts({101: 1}, 100)


def test_configurations_carry_the_plan_of_the_documents(spark):
    """All documents at sf0.1: the bound is reached, and configurations place all items over a quarter."""
    e = _encoder()
    lengths = [len(e.ids(r["text"] or "")) + 1 for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").toLocalIterator()]
    counts = Count(p for n in lengths for p in [(n - 1) % 2048 + 1] + [2048] * ((n - 1) // 2048))
    plan, placed = best_plan(dict(counts), 2048)
    assert sum(n for _, n in plan) == -(-sum(lengths) // 2048)
    assert placed >= 0.95 * sum(n for x, n in counts.items() if 512 < x < 2048)


# ---- WARC


def brute_warc(rows, least=0):
    groups = {}
    for i, h in rows:
        groups.setdefault((h or "").encode(), []).append(i)
    out = []
    for p, ids in groups.items():
        for i in ids:
            again = len(p) >= least and i != min(ids)
            out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if again else "response", min(ids) if again else None))
    return sorted(out)


HTML = [(5, "a\r\n\r\nWARC/1.1\r\n\r\n"), (3, "a\r\n\r\nWARC/1.1\r\n\r\n"), (9, None), (1, ""), (2, "é" * 300_000), (7, ""), (8, "x"), (10, "x")]


@pytest.mark.parametrize("least", [0, 2])
def test_warc_round_trip(spark, least):
    pages = spark.createDataFrame([(i, "http://h/ a\r\nX: y" if i % 2 else None, h, "extra") for i, h in HTML], "page_id long, url string, html string, record_type string")
    found = warc.warc_round_trip(pages, least).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(map(tuple, found.collect())) == brute_warc(HTML, least)
    assert warc.warc_round_trip(pages.limit(0)).count() == 0


def test_warc_nulls_and_repeats(spark):
    pages = spark.createDataFrame([(None, "u", "p"), (4, "u", "p"), (4, "u", "p"), (None, "u", "q")], "page_id long, url string, html string")
    found = sorted(((r["page_id"] or -1), r["record_type"], r["refers_to"]) for r in warc.warc_round_trip(pages).collect())
    assert found == [(-1, "response", None), (-1, "revisit", 4), (4, "response", None), (4, "response", None)]


def test_archives_are_deduplicated(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", h) for i, h in HTML], "page_id long, url string, html string")
    warc.write_warc(pages, str(tmp_path / "a"), min_bytes=10**9)  # everything is a response
    assert warc.read_warc(spark, str(tmp_path / "a")).where("warc_type = 'revisit'").count() == 0
    for source, target in (("a", "b"), ("b", "c")):
        warc.deduplicate_archives(spark, str(tmp_path / source), str(tmp_path / target))
        rows = warc.read_warc(spark, str(tmp_path / target)).collect()
        assert len(rows) == len(HTML) and sum(r["warc_type"] == "response" for r in rows) == len({h or "" for _, h in HTML})
        assert all(r["digest_ok"] in (True, None) for r in rows)


def test_deduplication_carries_all_records_over(spark, tmp_path):
    def record(kind, name, block, *more):
        head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: 2020-01-0{len(name)}T00:00:00Z", f"Content-Length: {len(block)}", *more]
        return ("WARC/1.1\r\n" + "\r\n".join(head)).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    page, away = b"HTTP/1.1 200 OK\r\nX: 1\r\n\r\npage\xff", "WARC-Payload-Digest: sha1:" + "A" * 32
    here = f"WARC-Payload-Digest: sha1:{warc.digest_of(page[-5:])}"
    lone = record("revisit", "eeeee", b"", away, "WARC-Refers-To: <urn:uuid:far>", "WARC-Refers-To-Date: 2019-01-01T00:00:00Z")
    others = [record("warcinfo", "a", b"software: x"), record("request", "ffffff", b"GET / HTTP/1.1\r\n\r\n", "WARC-Concurrent-To: <urn:uuid:bb>", "WARC-Concurrent-To: <urn:uuid:ccc>"), record("metadata", "ggggggg", b"k: v")]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.warc").write_bytes(b"".join([*others, record("response", "bb", page), record("response", "ccc", page), record("revisit", "dddd", b"", here, "WARC-Refers-To: <urn:uuid:ccc>"), lone]))
    warc.deduplicate_archives(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    raw = [x for f in (tmp_path / "out").glob("part*") for x in warc.raw_records_in(f.read_bytes())]
    whole = [h + b"\r\n\r\n" + b + b"\r\n\r\n" for h, b in raw]
    assert len(raw) == 7 and all(x in whole for x in [*others, lone])
    found = {h["warc-record-id"][10:-1]: (h["warc-type"], h.get("warc-refers-to"), h["warc-date"][:10], b) for h, b in ((warc.fields_of(h), b) for h, b in raw)}
    assert found["bb"] == ("response", None, "2020-01-02", page)
    assert found["ccc"] == ("revisit", "<urn:uuid:bb>", "2020-01-03", page[:-5])
    assert found["dddd"] == ("revisit", "<urn:uuid:bb>", "2020-01-04", b"")


def warc_record(kind, name, block, *more):
    head = [f"WARC-Type: {kind}", *([f"WARC-Record-ID: {name}"] if name else []), "WARC-Date: 2020-01-01T00:00:00Z", *more, f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(head)).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_records_are_members_of_their_own(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"page {i % 7} " * 50) for i in range(90)], "page_id long, url string, html string")
    warc.write_warc(pages, str(tmp_path / "w"), per_file=20)
    files = [p.read_bytes() for p in (tmp_path / "w").glob("part*")]
    seen = 0
    for blob in files:
        at, parts = 0, []
        while at < len(blob):  # any record can be read from its offset
            z = zlib.decompressobj(31)
            parts.append(z.decompress(blob[at:]))
            at = len(blob) - len(z.unused_data)
        assert all(p == b"\r\n\r\n" for p in parts[1::2]) and all(p.startswith(b"WARC/1.1\r\n") for p in parts[::2])
        assert len(parts[::2]) <= 20
        seen += len(parts[::2])
    assert seen == 90 and len(files) >= 5
    warc.write_warc(pages, str(tmp_path / "v"), file_bytes=2000)
    assert max(len(list(warc.records_in(p.read_bytes()))) for p in (tmp_path / "v").glob("part*")) <= 2000 // 400


def test_strange_archives_are_deduplicated(spark, tmp_path):
    """Ids of any form or none, orphans, revisits that name no digest, empty and odd types, gzip of many members."""
    import gzip

    page, other = b"HTTP/1.1 200 OK\r\n\r\npage", b"HTTP/1.1 200 OK\r\n\r\nother"
    digest = f"WARC-Payload-Digest: sha1:{warc.digest_of(b'page')}"
    records = [
        warc_record("response", "<urn:uuid:b>", page), warc_record("response", "<urn:uuid:a>", page), warc_record("response", "", page), warc_record("response", "", other),
        warc_record("revisit", "<urn:uuid:c>", b"", "WARC-Refers-To: <urn:uuid:b>"), warc_record("revisit", "", b"", digest), warc_record("revisit", "<urn:uuid:d>", b"", "WARC-Refers-To: <urn:uuid:z>"),
        warc_record("revisit", "<urn:uuid:e>", b""), warc_record("conversion", "", b"x"), warc_record("response", "<urn:page:7>", other),
    ]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    report = {r["outcome"]: r["n"] for r in warc.deduplicate_archives(spark, str(tmp_path / "in"), f"file://{tmp_path}/out").collect()}
    assert report == {"responses kept": 2, "responses made revisits": 3, "revisits resolved": 2, "revisits unresolved": 2, "others": 1}
    found = [(h, b) for f in (tmp_path / "out").glob("part*") for h, b in warc.records_in(f.read_bytes())]
    assert len(found) == len(records)
    of = lambda kind: Count((h.get("warc-record-id"), h.get("warc-refers-to")) for h, _ in found if h["warc-type"] == kind)
    a, seven = "<urn:uuid:a>", "<urn:page:7>"
    assert of("response") == {(a, None): 1, (seven, None): 1}
    assert of("revisit") == {("<urn:uuid:b>", a): 1, (None, a): 2, (None, seven): 1, ("<urn:uuid:c>", a): 1, ("<urn:uuid:d>", "<urn:uuid:z>"): 1, ("<urn:uuid:e>", None): 1}
    payloads = [b for h, b in found if h["warc-type"] == "response"]
    assert sorted(payloads) == sorted([page, other])


def test_foreign_digests_are_resolved_by_reference(spark, tmp_path):
    page, far = b"HTTP/1.1 200 OK\r\n\r\npage", "WARC-Payload-Digest: sha256:" + "0" * 64
    records = [
        warc_record("response", "<urn:uuid:a>", page, far), warc_record("revisit", "<urn:uuid:b>", b"", far, "WARC-Refers-To: <urn:uuid:a>"), warc_record("revisit", "<urn:uuid:c>", b"", far, "WARC-Refers-To: <urn:uuid:z>"),
        warc_record("revisit", "<urn:uuid:d>", b"", "WARC-Payload-Digest: sha1:" + "A" * 32, "WARC-Refers-To: <urn:uuid:a>"),  # says itself that it is another
    ]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.warc").write_bytes(b"".join(records))
    report = {r["outcome"]: r["n"] for r in warc.deduplicate_archives(spark, str(tmp_path / "in"), str(tmp_path / "out")).collect()}
    assert report == {"responses kept": 1, "revisits resolved": 1, "revisits unresolved": 2}
    found = {h["warc-record-id"]: h for f in (tmp_path / "out").glob("part*") for h, _ in warc.records_in(f.read_bytes())}
    assert found["<urn:uuid:b>"]["warc-payload-digest"] == f"sha1:{warc.digest_of(b'page')}" and found["<urn:uuid:b>"]["warc-refers-to"] == "<urn:uuid:a>"
    assert found["<urn:uuid:c>"]["warc-payload-digest"] == "sha256:" + "0" * 64


def test_archives_that_only_spark_can_open(spark, tmp_path, monkeypatch):
    from types import SimpleNamespace

    def closed(path):
        raise ValueError("no such store")

    pages = spark.createDataFrame([(i, "u", "x" * i) for i in range(30)], "page_id long, url string, html string")
    warc.write_warc(pages, f"file://{tmp_path}/w")
    streamed = sorted(map(tuple, warc.read_warc(spark, f"file://{tmp_path}/w").collect()), key=repr)
    monkeypatch.setattr(warc, "pafs", SimpleNamespace(FileSystem=SimpleNamespace(from_uri=closed)))
    assert sorted(map(tuple, warc.read_warc(spark, f"file://{tmp_path}/w").collect()), key=repr) == streamed and len(streamed) == 30


def test_readers_hold_a_record_at_a_time(tmp_path):
    import gzip

    block = b"x" * 300_000
    blob = b"".join(gzip.compress(warc_record("resource", f"<urn:{i}>", block)) for i in range(5))
    pieces = (blob[i : i + 777] for i in range(0, len(blob), 777))
    assert [len(b) for _, b in warc.records_in(pieces)] == [300_000] * 5
    with pytest.raises(ValueError):
        list(warc.records_in(iter([blob[:-200]])))
    assert list(warc.records_in(b"")) == []


def test_reader_takes_single_and_many_member_gzip():
    import gzip

    one = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    for blob in (one * 3, gzip.compress(one * 3), gzip.compress(one) + gzip.compress(one) * 2):
        assert [b for _, b in warc.records_in(blob)] == [b"abc"] * 3
    with pytest.raises(ValueError):
        list(warc.records_in(one[:-9]))
    with pytest.raises(ValueError):
        list(warc.records_in(b"nothing\r\n\r\n"))
