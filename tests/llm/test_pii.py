import re
import time

from weftgraph.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def holds(kind, match):
    digits = re.sub(r"\D", "", match)
    return {
        "email": lambda: True,
        "ip": lambda: all(int(p) <= 255 for p in match.split(".")),
        "card": lambda: 12 <= len(digits) <= 19 and luhn(digits),
        "phone": lambda: 9 <= len(digits) <= 15,
    }[kind]()


def base_spans(text):
    found = [(m.start(), i, m.end(), k) for i, (k, p) in enumerate(BASE.items()) for m in re.finditer(p, text or "") if holds(k, m[0])]
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(found)]


TEXTS = [
    None,
    "",
    " \n",
    "write to a.b+c@d-e.example.org. or x@y, z@q.r_s@t.u",
    "a@b.c@d.e f@@g.h .@.x.y -@-.-",
    "hosts 1.2.3.4.5.6.7.8 and 256.1.1.1 and 0001.2.3.0255 1.2.3 00000000000000000000000001.1.1.1",
    "card 4111 1111 1111 1111, 4111-1111-1111-1112, 4111  1111 1111 1111, 37828224631000 5, 3782-822463-10005",
    "call +49 (30) 901820 now, +1-2, +1 ( ( (, ++44 20 7946 0958+1 650 253 0000.",
    "é😀 a@b.cd 😀 4111111111111111 \x01 x@y.zz \x02 +4930901820",
    "1" * 40 + " 4111111111111111 " + "0" * 12,
    "a@b.c a@b.c a@b.c 1.1.1.1 1.1.1.1",
]


def test_base_spans_are_those_of_plain_python(docs_of):
    rows = list(enumerate(TEXTS)) + [(3, TEXTS[3]), (None, TEXTS[6])]
    got = pii.pii_scan(docs_of(rows)).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        spans = [s for s in r["spans"].split(",") if s.split(":")[0] in BASE]
        assert spans == base_spans(texts[r["doc_id"]]), r
        assert [r[f"n_{k}"] for k in BASE] == [sum(s.startswith(k + ":") for s in spans) for k in BASE]
        assert len(r["scores"].split(",")) == len(r["spans"].split(","))
    assert pii.pii_scan(docs_of(rows).limit(0)).count() == 0


def test_checksums_and_context(docs_of):
    rows = [
        (0, "my account DE89 3704 0044 0532 0130 00 please"),
        (1, "my account DE88 3704 0044 0532 0130 00 please"),
        (2, "ssn: 123-45-6789"),
        (3, "part 123-45-6789"),
        (4, "phone (650) 253-0000"),
        (5, "part 650-253-0000"),
        (6, "sample card 4111111111111111"),
        (7, "order 4111111111111111"),
        (8, "ssn 000-12-3456, ssn 123-45-67890"),
        (9, "xDE89370400440532013000 GB82WEST12345698765432"),
    ]
    got = {r["doc_id"]: r for r in pii.pii_scan(docs_of(rows)).collect()}
    assert [got[i]["n_iban"] for i in (0, 1, 9)] == [1, 0, 0]
    assert [got[i]["n_ssn"] for i in (2, 3, 8)] == [1, 0, 0]
    assert [got[i]["n_local"] for i in (4, 5)] == [1, 0]
    assert (got[6]["scores"], got[7]["scores"]) == ("9", "2") and got[6]["n_card"] == got[7]["n_card"] == 1
    found = {(r["doc_id"], r["kind"], r["value"], r["score"]) for r in pii.find_pii(docs_of(rows[:1])).collect()}
    assert (0, "iban", "DE89 3704 0044 0532 0130 00", 10) in found


def test_long_runs_take_linear_time(docs_of):
    units = ["a", "1", "1.", "1 ", "+1(", "a@", "a@b.", "A1"]
    rows = [(i, u * 100_000) for i, u in enumerate(units)]
    short = {i: base_spans(u * 30) for i, u in enumerate(units)}
    start = time.time()
    for r in pii.pii_scan(docs_of(rows)).collect():
        got = [s for s in r["spans"].split(",") if s.split(":")[0] in BASE]
        assert got[: len(short[r["doc_id"]]) - 1] == short[r["doc_id"]][:-1]
    assert time.time() - start < 60


def test_many_matches_have_their_places(docs_of):
    text = "x " + "é a@b.cd 1.2.3.4 " * 3000
    assert pii.pii_scan(docs_of([(0, text)])).first()["spans"] == ",".join(base_spans(text))
