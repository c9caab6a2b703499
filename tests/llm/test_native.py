"""Source mixing, licences, quality and secrets: brute force, hand-made cases and plans."""

import hashlib
import math
import os
import random
import re
import textwrap
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from weftgraph.llm.licenses import FULL_TEXTS, NAMES, OPENINGS, SPELLINGS, TELLING, TEXTS, canonical, canonical_text, known_forms, known_licenses, license_scan
from weftgraph.llm.mixing import leaf_budgets, mix_sources
from weftgraph.llm.pii import pii_scan
from weftgraph.llm.quality import binomial_cdf, quality_rules
from weftgraph.llm.secrets import secret_scan

# ---- mixing


def fill(children, given):
    """Water filling: {name: (cap, weight)} -> {name: budget}, exactly."""
    out, open_, left = {}, {k: v for k, v in children.items() if v[1] > 0}, given
    out |= {k: 0 for k, v in children.items() if v[1] <= 0}
    while open_:
        total = sum(w for _, w in open_.values())
        full = [k for k, (c, w) in open_.items() if c * total <= w * left]
        if not full:
            break
        for k in full:
            out[k] = open_[k][0]
        left -= sum(open_.pop(k)[0] for k in full)
    total = sum(w for _, w in open_.values())
    shares = {k: Fraction(w * left, total) for k, (_, w) in open_.items()}
    out |= {k: int(s) for k, s in shares.items()}
    spare = left - sum(int(s) for s in shares.values()) if shares else 0
    for k in sorted(shares, key=lambda k: (-(shares[k] - int(shares[k])), k))[:spare]:
        out[k] += 1
    return out


def tree_budgets(leaves, weights, epochs, total):
    cap = {k: n * epochs if weights.get(k, 1) > 0 else 0 for k, n in leaves.items()}
    level = lambda n: sorted({k[:n] for k in leaves})
    below = lambda p: sum(c for k, c in cap.items() if k[: len(p)] == p and all(weights.get(k[:i], 1) > 0 for i in range(len(p), 4)))
    budget = {(): total}
    for n in (1, 2, 3):
        for parent in level(n - 1) if n > 1 else [()]:
            kids = {k: (cap[k] if n == 3 else below(k), weights.get(k, 1)) for k in level(n) if k[:-1] == parent}
            budget |= fill(kids, budget[parent])
    return {k: b for k, b in budget.items() if len(k) == 3}


@pytest.mark.parametrize("seed", range(4))
def test_budgets_against_exact_water_filling(spark, seed):
    rng = random.Random(seed)
    leaves = {(d, x, s): rng.randrange(0, 5000) for d in "ab" for x in ("en", "de") for s in ("s1", "s2", "s3")}
    weights = {(d,): rng.randrange(1, 9) for d in "ab"} | {k: rng.randrange(0, 7) for k in leaves if rng.random() < 0.7} | {("a", "en"): 5}
    total = sum(leaves.values())
    num = rng.randrange(1, 30)
    df = spark.createDataFrame([(*k, n) for k, n in leaves.items()], "domain string, language string, source string, tokens long")
    found = {(r["domain"], r["language"], r["source"]): r["budget"] for r in leaf_budgets(df, weights, 3, num, 10).collect()}
    assert found == tree_budgets(leaves, weights, 3, total * num // 10)


def test_shortage_goes_to_siblings_first(spark):
    df = spark.createDataFrame([("a", "en", "x", 100), ("a", "en", "y", 900), ("b", "en", "z", 1000)], "domain string, language string, source string, tokens long")
    found = {r["source"]: r["budget"] for r in leaf_budgets(df, {}, 1, 1, 2).collect()}
    assert found == {"x": 100, "y": 400, "z": 500}


def test_mix_reads_its_budget(docs_of):
    rng = random.Random(6)
    rows = [(i, " ".join("w" for _ in range(rng.randrange(0, 40))), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", None])) for i in range(400)] + [(400, None, "en", "s1")]
    for epochs, num, den in ((1, 1, 2), (3, 2, 1), (2, 1, 1)):
        got = mix_sources(docs_of(rows), {("d", "en"): 7}, F.lit("d"), epochs, num, den).collect()
        total = sum(r["n_tokens"] for r in got)
        assert len(got) == len(rows) and sum(r["taken_tokens"] for r in got) == min(total * num // den, total * epochs)
        leaf = {}
        for r in got:
            leaf.setdefault((r["language"], r["source"]), [r["leaf_budget"], 0])[1] += r["taken_tokens"]
            assert 0 <= r["prefix_tokens"] <= r["n_tokens"]
        assert all(b == t for b, t in leaf.values())
        cut = [r for r in got if 0 < r["prefix_tokens"] < r["n_tokens"]]
        assert len(cut) <= len(leaf)  # a prefix ends inside one document of a leaf at most
    assert mix_sources(docs_of(rows).limit(0), {}, F.lit("d")).count() == 0


# ---- licences


def test_known_texts_and_variants(docs_of):
    mit = "Copyright (c) 2020 Someone\n\n" + TEXTS["MIT"].upper().replace(" ", "  ")
    rows = [
        (1, mit),
        (2, "text\nReleased under the M.I.T. licence\nmore"),
        (3, "text\n* Released under the MIT Licence! \nLicensed under the Apache License, Version 2.0.\nLicensed under the Apache License, Version 2.0."),
        (4, "Released under the MIT Licensé."),
        (5, None),
        (6, ""),
        (7, "No licence at all"),
        (8, "© 2001 X\nAll rights reserved.\n" + TEXTS["BSD-3-Clause"]),
    ]
    found = {r["doc_id"]: (r["text_license"], r["n_license_lines"], r["licenses"]) for r in license_scan(docs_of(rows)).collect()}
    assert found[1][0] == "MIT" and found[8][0] == "BSD-3-Clause"
    assert found[3] == (None, 3, "Apache-2.0,MIT")
    assert all(found[i] == (None, 0, "") for i in (2, 4, 5, 6, 7))
    assert license_scan(docs_of(rows).limit(0)).count() == 0
    twice = license_scan(docs_of([(None, "Licensed under MIT"), (None, "Licensed under MIT")])).collect()
    assert [r["n_license_lines"] for r in twice] == [1, 1]


def test_every_known_form_is_found(docs_of):
    notices = [(f"{opening} under {w}", name) for opening in OPENINGS for name, words in NAMES.items() for w in words]
    rows = [(i, f"text\n* {n.upper()}!\nmore") for i, (n, _) in enumerate(notices)]
    found = {r["doc_id"]: r["licenses"] for r in license_scan(docs_of(rows)).collect()}
    assert found == {i: name for i, (_, name) in enumerate(notices)}
    forms = known_forms()
    assert len(forms) + len(FULL_TEXTS) == len(known_licenses()) and all(re.search(TELLING, t) for t, _ in forms)
    assert all(re.search(TELLING, t) for t in TEXTS.values())  # of a run of paragraphs one tells
    # no telling string comes from another spelling alone, so one in the canonical form is one in the text
    assert not any(re.search(TELLING, b) and not re.search(TELLING, a) for a, b in SPELLINGS)


def test_own_digests_are_matched_whatever_they_hold(docs_of, spark):
    known = spark.createDataFrame([(hashlib.sha256(canonical_text(t).encode()).hexdigest(), t) for t in ("Do what you like", "Free for all")], "digest string, license_id string")
    found = {r["doc_id"]: r[1:] for r in license_scan(docs_of([(1, "Do what you like!"), (2, "a\nfree for ALL\n\nb"), (3, ""), (4, None)]), known=known).collect()}
    assert found == {1: ("Do what you like", 1, 1, "Do what you like"), 2: (None, 1, 0, "Free for all"), 3: (None, 0, 0, ""), 4: (None, 0, 0, "")}


def wrapped(text, width, mark):
    """A text as a block of a source file: lines of ``width``, each behind ``mark``, paragraphs parted by a bare mark."""
    return f"\n{mark}\n".join("\n".join(f"{mark} {line}" for line in textwrap.wrap(p, width)) for p in text.split("\n"))


def test_texts_as_they_are_met(docs_of):
    isc = "ISC License\n\nCopyright (c) 2004, Someone <a@b.c>\n\n" + "\n\n".join("\n".join(textwrap.wrap(p, 78)) for p in TEXTS["ISC"].split("\n")) + "\n"
    assert any(line.startswith("copyright notice") for w in range(40, 100) for line in textwrap.wrap(TEXTS["ISC"], w))
    bsd = TEXTS["BSD-2-Clause"].replace("1. ", "* ").replace("2. ", "* ")
    letters = TEXTS["BSD-3-Clause"].replace("1. ", "(a) ").replace("2. ", "(b) ").replace("3. ", "(c) ")
    rows = [(w, "Copyright 2004 X\n" + "\n".join(textwrap.wrap(TEXTS["ISC"], w))) for w in range(40, 100)]
    rows += [(200, isc), (201, "The MIT License (MIT)\n\nCopyright (c) 2015 X Y\n\n" + TEXTS["MIT"].replace("\n", "\n\n")), (202, bsd), (203, letters)]
    rows += [(300 + i, "/*\n" + wrapped(TEXTS["MIT"], w, " *") + "\n */\n#include <x.h>\n\nint main(void) { return 0; }\n") for i, w in enumerate((50, 72, 90))]
    rows += [(400, "import x\n\n" + wrapped("Copyright 2020 X\n" + TEXTS["BSD-3-Clause"], 70, "#") + "\n\nprint(x)\n\n" + wrapped(TEXTS["Zlib"], 60, "//"))]
    rows += [(500, "some words\n" * 30_000 + "\n" + wrapped(TEXTS["MIT"], 60, ";;") + "\n\n" + "other words " * 90_000)]
    rows += [(600, wrapped(TEXTS["MIT"].rsplit("\n", 1)[0], 60, "#")), (601, "The above copyright notice and this permission notice shall be included.\n\nlicence")]
    found = {r["doc_id"]: (r["text_license"], r["n_license_blocks"], r["licenses"]) for r in license_scan(docs_of(rows)).collect()}
    assert all(found[w][0] == "ISC" for w in range(40, 100))
    assert found[200] == ("ISC", 1, "ISC") and found[201] == ("MIT", 1, "MIT")
    assert found[202][::2] == ("BSD-2-Clause", "BSD-2-Clause") and found[203][::2] == ("BSD-3-Clause", "BSD-3-Clause")
    assert all(found[300 + i] == (None, 1, "MIT") for i in range(3))
    assert found[400] == (None, 2, "BSD-3-Clause,Zlib") and found[500] == (None, 1, "MIT")
    assert found[600] == found[601] == (None, 0, "")  # parts of a text


@pytest.mark.skipif(not os.path.isdir("/usr/share/common-licenses"), reason="this system keeps no licence texts")
def test_full_texts_are_found(docs_of):
    files = {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "MPL-2.0": "MPL-2.0", "GFDL-1.3": "GFDL-1.3", "MPL-1.1": "MPL-1.1"}
    texts = [(name, open(f"/usr/share/common-licenses/{f}", encoding="utf-8").read()) for name, f in files.items()]
    rows = [(i, t) for i, (_, t) in enumerate(texts)] + [(100 + i, " ".join(t.upper().split(" "))) for i, (_, t) in enumerate(texts)]
    found = {r["doc_id"]: r["text_license"] for r in license_scan(docs_of(rows)).collect()}
    assert all(found[i] == found[100 + i] == name for i, (name, _) in enumerate(texts))


def test_canonical_is_alike_in_both_places(spark):
    rng = random.Random(8)
    bits = ["licence", "v2", "v2", "Sub-License", " ", " ", "\n", "\n# ", "(c) ", "a) ", "2. ", ": ", "Copyright", " 2020", "©", "all rights reserved", "é", "½", "_", "copyright notice", "per cent", "**"]
    texts = ["".join(rng.choices(bits, k=rng.randrange(25))) for _ in range(400)] + ["v2 v2 v2", "ver v2 ver v3", "1. a\n2. b"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(canonical(F.col("t"))).collect()]
    assert got == [canonical_text(t) for t in texts]
    assert canonical_text("v2 v2 v2") == "version 2 version 2 version 2"


# ---- quality


def brute_quality(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    hit = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(5)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w)


def test_quality_base_against_brute_force(docs_of, spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice(["a ", "b ", "c\n", "é😀 ", "#%x ", "\t", "\n", "  ", "long|word "]) for _ in range(rng.randrange(0, 90))) for _ in range(120)]
    texts += [None, "", " ", "one two three four five", "a b c d e a b c d e", "z " * 4000, "p q r s t u v\n" * 5]
    rows = list(enumerate(texts))
    labels = spark.createDataFrame([], "doc_id long, quality int")
    found = {r["doc_id"]: r for r in quality_rules(docs_of(rows), labels).collect()}
    for i, t in rows:
        r = found[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute_quality(t)
        assert r["kept"] == (not r["base_failed"])  # no labels, no cutoffs
    assert quality_rules(docs_of(rows).limit(0), labels).count() == 0


def test_cutoffs_are_proven_and_reject_junk(docs_of, spark):
    good = [(i, " ".join(f"word{i}x{j}" for j in range(30)), "en", "s") for i in range(900)]
    junk = [(1000 + i, " ".join(f"w{i}%%%{j}" for j in range(30)), "en", "s") for i in range(20)]
    few = [(2000 + i, " ".join(f"f{i}%%%{j}" for j in range(30)), "de", "s") for i in range(20)]
    labels = spark.createDataFrame([(i, 1) for i in range(900)] + [(1000 + i, 0) for i in range(20)] + [(None, 1), (5, None), (2001, 1)], "doc_id long, quality int")
    found = {r["doc_id"]: r["kept"] for r in quality_rules(docs_of(good + junk + few), labels).collect()}
    assert all(found[i] for i in range(900)) and not any(found[1000 + i] for i in range(20))
    assert all(found[2000 + i] for i in range(20))  # a stratum without enough labels has no cutoffs


def test_binomial_bound_is_exact(spark):
    cases = [(k, n, p) for n in (1, 7, 50, 400, 5000) for p in (0.01, 0.05) for k in {0, 1, int(n * p / 2), int(n * p)} if k < n * p]
    for p in (0.01, 0.05):
        df = spark.createDataFrame([(k, n) for k, n, q in cases if q == p], "k long, n long").withColumn("c", binomial_cdf(F.col("k"), F.col("n"), p))
        for r in df.collect():
            q = Fraction(p)
            exact = float(sum(math.comb(r["n"], i) * q**i * (1 - q) ** (r["n"] - i) for i in range(r["k"] + 1)))
            assert math.isclose(r["c"], exact, rel_tol=1e-8)


# ---- secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
PIECES = ["password", "PassWD", "secret", "token", "api_key", "API_KEY", " ", "  ", ":", "=", '"', "'", "abc", "abcdefgh", "AKIA", "AKIA" + "Q7" * 9, "0123456789abcdef" * 2, "é", "😀", "\x01", "\n", "ſecret", "toKen", "/", "-"]


def base_spans(t):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24])


def test_base_spans_against_brute_force(docs_of):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice(PIECES) for _ in range(rng.randrange(1, 40)))) for i in range(400)] + [(400, None), (401, ""), (402, "token=abcdef " * 5000)]
    for r in secret_scan(docs_of(rows)).collect():
        spans = base_spans(rows[r["doc_id"]][1] or "")
        text = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == j for _, k, _ in spans) for j in range(3))
    assert secret_scan(docs_of(rows).limit(0)).count() == 0


def test_weak_parts_need_each_other(docs_of):
    bare, user, url = "Ab1+" * 10, "user=robert", "https://h.example/x"
    rows = [(1, f"{user} and {bare}"), (2, f"{user} {'x ' * 300}{bare}"), (3, bare), (4, f"see {url}"), (5, f"{url} {bare}"), (6, f"{user} token=abcdefgh"), (None, f"{user} {bare}"), (None, f"{user} {bare}")]
    found = [(r["doc_id"], r["n_linked"], r["spans"]) for r in secret_scan(docs_of(rows)).collect()]
    n = {i: k for i, k, _ in found if i is not None}
    assert n == {1: 2, 2: 0, 3: 0, 4: 0, 5: 2, 6: 1} and [k for i, k, _ in found if i is None] == [2, 2]
    assert dict((i, s) for i, _, s in found)[1] == "identifier:0:11,bare:16:56"


def weak_spans(t):
    """(start, kind, end) of identifiers, bare secrets and endpoints, by patterns of their own."""
    out = [(m.start(), 3, m.end()) for m in re.finditer(r"""(ASIA|AROA|AIDA)[A-Z0-9]{16,}|(client_id|access_key_id|account_id|username|user)["']?[ ]*[:=][ ]*["']?[a-zA-Z0-9_.@-]{4,}""", t)]
    bare = re.finditer(r"[A-Za-z0-9+/]+", t)
    out += [(m.start(), 4, m.end() + len(re.match("={0,2}", t[m.end() :])[0])) for m in bare if len(m[0]) >= 32 and re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])]
    return out + [(m.start(), 5, m.end()) for m in re.finditer(r"(https|http|ftp|amqp|redis|mongodb|mysql|postgresql|postgres)://[^\s\"'<>]+", t, re.A)]


def linked(t, scope):
    base = base_spans(t)
    kept = [w for w in weak_spans(t) if not any(b[0] == w[0] for b in base)]
    outer = base + [w for w in kept if w[1] == 5]
    kept = [w for w in kept if w[1] == 5 or not any(o[0] <= w[0] and w[2] <= o[2] for o in outer)]
    role = {0: "secret", 1: "id", 2: "secret", 3: "id", 4: "secret", 5: "end"}
    needs = {3: {"secret"}, 4: {"id", "end"}, 5: {"secret"}}
    apart = lambda x, y: x[2] <= y[0] or y[2] <= x[0]
    return sorted(w for w in kept if any(role[o[1]] in needs[w[1]] and abs(o[0] - w[0]) <= scope and apart(o, w) for o in base + kept))


def test_links_against_brute_force(docs_of):
    rng = random.Random(6)
    bits = ["user=robert", "client_id: 'ab12'", "ASIA" + "X9" * 8, "Ab1+" * 9, "x" * 40, "0af3" * 8, "token=abcdefgh", "https://h.example/a", "redis://u:Ab1+Ab1+Ab1+Ab1+Ab1+Ab1+Ab1+Ab1+@h", "AKIA" + "Q7" * 9, " ", " ", "\n", "words and words ", "é ", "https://h/?token=abcdefgh", "password: " + "Zz9/" * 10 + "=="]
    rows = [(i, "".join(rng.choice(bits) + rng.choice(["", " ", " " * 30]) for _ in range(rng.randrange(1, 14)))) for i in range(500)]
    rows += [(900, "https://example.com/wp/content/uploads/2015/08/photograph/large/index"), (901, "https://h/?token=abcdefgh"), (902, "user=robert " * 3000 + "Ab1+" * 9), (903, "Ab1+" * 50_000)]
    names = ("assign", "access", "hex", "identifier", "bare", "endpoint")
    text = dict(rows)
    for r in secret_scan(docs_of(rows), scope=60).collect():
        t = text[r["doc_id"]]
        spans = sorted(base_spans(t) + linked(t, 60))
        assert r["spans"] == ",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans), t[:300]
        if r["doc_id"] in (900, 903):
            assert r["spans"] == ""  # a lone address, and a lone long word, tell nothing


def test_native_plans_have_no_python(docs_of, spark, capsys):
    docs, labels = docs_of([(1, "a b")]), spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    for df in (mix_sources(docs, {}, F.lit("d")), license_scan(docs), quality_rules(docs, labels), secret_scan(docs), pii_scan(docs)):
        df.explain()
    text = capsys.readouterr().out
    assert not re.search("Python|Pandas|InArrow|CartesianProduct", text)
