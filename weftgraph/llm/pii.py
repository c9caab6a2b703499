"""Personal data: patterns propose spans, checksums confirm them, context words move their score (operator 11).

DataFrame functions only.  Base kinds are reported wherever their pattern and validator hold.  Further kinds
need more: an IBAN its mod-97 check, weak kinds (social security numbers, national telephone numbers) a
score of ``LEAST``, which only words nearby can give them.  Every span has a score from 0 to 10: what its
kind starts with, plus and minus what the words around it say.

A text's spans are found in one pass without any shuffle: matches are wrapped in a control character and
the text is split at it; a match's place is the sum of the lengths of the pieces before it, taken in blocks,
so that a text of very many matches isn't summed from its beginning for each of them.  Context is what lies
between a match and its neighbours of the same kind, up to ``CONTEXT`` code points on each side.

Patterns are linear on any text: where a match could only begin later inside a run that it can also begin
with, a look-behind keeps it from being tried there.
"""

from __future__ import annotations

from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import only, text_of

CONTEXT = 40
#: Score that a weak kind must reach.
LEAST = 5


@dataclass(frozen=True)
class Kind:
    """``pattern`` is for Java, ``plain`` the same for RE2; ``gate`` is what any text with a match holds; words
    are alternatives of a pattern, looked for with A-Z in lower case."""

    name: str
    pattern: str
    plain: str
    gate: str
    score: int
    words: str
    against: str = "example|sample|dummy"


# The patterns of the base kinds; then those of the further kinds.
KINDS = [
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", r"@[A-Za-z0-9-]", 8, r"mail|contact|write to"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", r"[0-9]\.[0-9]", 5, r"(?:^|[^a-z0-9])ip(?:$|[^a-z0-9])|address|host|server|login|client", r"version|release|section|chapter"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9])+", r"[0-9](?:[\x20-]?[0-9]){11}", 6, r"card|visa|credit|debit|amex|master|payment", r"order|invoice|tracking|isbn|serial|imei"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", 6, r"phone|tel|call|mobile|fax|sms|whatsapp"),
    Kind("iban", r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+", r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}", r"[A-Z]{2}[0-9]{2}", 8, r"iban|account|bank|transfer|konto|compte"),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", 3, r"(?:^|[^a-z0-9])ssn(?:$|[^a-z0-9])|social security|taxpayer|insurance"),
    Kind("local", r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}", r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}", r"[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-]", 2, r"phone|telephone|(?:^|[^a-z0-9])tel(?:$|[^a-z0-9])|call|mobile|fax"),
]
N_BASE = 4
_MARK, _STAND_IN = "\x01", "\x02"


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    value = lambda c, i: F.when(i % 2 == 1, F.when(c > 4, 2 * c - 9).otherwise(2 * c)).otherwise(c)
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: value(c.cast("int"), i))
    return F.aggregate(each, F.lit(0), lambda acc, x: acc + F.coalesce(x, F.lit(0))) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether letters and digits, the first four moved to the end and letters as 10 to 35, are 1 modulo 97."""
    moved = F.concat(F.substr(iban, F.lit(5)), F.substring(iban, 1, 4))
    number = lambda c: F.when(F.rlike(c, F.lit("[0-9]")), c.cast("int")).otherwise(F.ascii(c) - 55)
    step = lambda acc, c: (F.when(number(c) < 10, acc * 10).otherwise(acc * 100) + number(c)) % 97
    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), step) == 1


def _valid(kind: str, match: Column) -> Column:
    """What a match must pass besides its pattern."""
    n = F.length(_digits(match))
    if kind == "ip":
        return F.forall(F.split(match, "\\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.substring(F.ltrim(p, F.lit("0")), 1, 3), F.lit("")).try_cast("int").isNull() | (F.substring(F.ltrim(p, F.lit("0")), 1, 3).try_cast("int") <= 255)))
    if kind == "card":
        # at most 19 digits and 18 separators, so a longer match is never taken apart
        return F.when(F.length(match) > 37, F.lit(False)).otherwise(n.between(12, 19) & luhn(_digits(match)))
    if kind == "phone":
        return n.between(9, 15)
    if kind == "iban":
        plain = F.replace(match, F.lit(" "), F.lit(""))
        return F.length(plain).between(15, 34) & mod97(plain)
    if kind == "ssn":
        return ~F.rlike(match, F.lit("^(?:000|666|9)|-00-|-0000$"))
    return F.lit(True)


def _clear(kind: Kind, before: Column, match: Column, after: Column) -> Column:
    """Whether a match of a further kind isn't a part of something longer."""
    if kind.name == "iban":
        return ~F.rlike(after, F.lit("^[A-Za-z0-9]")) & ~F.rlike(before, F.lit("[A-Za-z0-9]$"))
    if kind.name in ("ssn", "local"):
        return ~F.rlike(after, F.lit("^-?[0-9]")) & ~F.rlike(before, F.lit("[0-9+][\\x20.-]?$"))
    return F.lit(True)


def _score(kind: Kind, before: Column, after: Column) -> Column:
    """From 0 to 10: what the kind starts with, three more by its words, four less by words against it."""
    around = F.translate(F.concat(before, F.lit(" \n "), after), ascii_uppercase, ascii_lowercase)
    says = lambda words: F.rlike(around, F.lit(words)).cast("int")
    return F.greatest(F.lit(0), F.least(F.lit(10), kind.score + 3 * says(kind.words) - 4 * says(kind.against)))


def _starts(lengths: Column) -> Column:
    """The running sums of an array of lengths, each without its own, by blocks of about the root of the size."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda acc, x: acc + x)

    def within(a: Column, block: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / block).cast("int")), lambda j: total(F.slice(a, j * block + 1, block)))
        heads = _let(blocks, lambda b: F.transform(b, lambda _, j: total(F.slice(b, F.lit(1), j))))
        return _let(heads, lambda h: F.transform(a, lambda _, i: F.get(h, F.floor(i / block).cast("int")) + total(F.slice(a, (i - i % block) + 1, i % block))))

    return _let(lengths, lambda a: _let(F.greatest(F.lit(8), F.ceil(F.sqrt(F.size(a))).cast("int")), lambda block: within(a, block)))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _found(i: int, kind: Kind, text: Column) -> Column:
    """The spans of a kind in a text: an array of (start, kind, end, score, value)."""
    pieces = F.split(F.regexp_replace(text, f"({kind.pattern})", f"{_MARK}$1{_MARK}"), _MARK)

    def spans(p: Column) -> Column:
        near = lambda j: F.coalesce(F.get(p, j), F.lit(""))

        def one(j: Column, starts: Column) -> Column:
            match, before, after = F.get(p, j), F.right(near(j - 1), F.lit(CONTEXT)), F.left(near(j + 1), F.lit(CONTEXT))
            good = _valid(kind.name, match)
            score = _score(kind, before, after)
            if i >= N_BASE:
                good = good & _clear(kind, before, match, after) & (score >= LEAST)
            start = F.get(starts, j)
            return F.when(good, F.struct(start.cast("long").alias("start"), F.lit(i).alias("kind"), (start + F.length(match)).cast("long").alias("end"), score.alias("score"), match.alias("value")))

        hits = F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda j: j % 2 == 1)
        return _let(_starts(F.transform(p, lambda x: F.length(x))), lambda starts: F.filter(F.transform(hits, lambda j: one(j, starts)), lambda s: s.isNotNull()))

    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,score:int,value:string>>")
    return F.when(F.rlike(text, F.lit(kind.gate)), _let(pieces, spans)).otherwise(none)


def with_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, _spans): for each row its spans (start, kind, end, score, value), by start, then kind; kinds are
    places in ``KINDS``."""
    own = only(docs, id_col, text_col).select(F.col(id_col), F.replace(text_of(text_col), F.lit(_MARK), F.lit(_STAND_IN)).alias("_text"))
    return own.select(id_col, F.array_sort(F.concat(*[_found(i, k, F.col("_text")) for i, k in enumerate(KINDS)])).alias("_spans"))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, kind, start, end, score, value): a row for each span, places in code points, end exclusive.

    Rows of ``docs`` without spans give none; nulls, repeats and other columns are as for ``pii_scan``.
    """
    rows = with_spans(docs, id_col, text_col).select(id_col, F.explode("_spans").alias("_s"))
    return rows.select(id_col, F.element_at(F.array(*[F.lit(k.name) for k in KINDS]), F.col("_s.kind") + 1).alias("kind"), "_s.start", "_s.end", "_s.score", "_s.value")


def pii_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores, n_iban, n_ssn, n_local.

    Spans are ``kind:start:end`` in code points, end exclusive, by start and then kind, comma-joined;
    base_sha256 is of those of the base kinds, scores are the spans' own in the same order.  Null and empty
    texts have none; very long ones are read whole.  Repeated rows get the same result each; null ids are
    kept.  An empty table gives an empty result.  Other columns are ignored, whatever their names.
    """
    names = F.array(*[F.lit(k.name) for k in KINDS])
    text = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")
    many = lambda i: F.size(F.filter("_spans", lambda x: x["kind"] == i)).cast("long").alias(f"n_{KINDS[i].name}")
    base = F.filter("_spans", lambda x: x["kind"] < N_BASE)
    scores = F.array_join(F.transform("_spans", lambda x: x["score"].cast("string")), ",")
    return with_spans(docs, id_col, text_col).select(
        id_col, *[many(i) for i in range(N_BASE)], F.sha2(text(base), 256).alias("base_sha256"), text(F.col("_spans")).alias("spans"), scores.alias("scores"), *[many(i) for i in range(N_BASE, len(KINDS))]
    )


def pii_sql() -> str:
    """The same rows in DuckDB's SQL; positions by running sums of pieces as rows."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    good = {
        "ip": "len(list_filter(string_split(p, '.'), lambda x: len(ltrim(x, '0')) > 3 OR coalesce(try_cast(left(ltrim(x, '0'), 3) AS INT), 0) > 255)) = 0",
        "card": "len(p) <= 37 AND len(g) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, len(g) + 1), lambda i: CASE WHEN (i - 1) % 2 = 0 THEN g[len(g) + 1 - i]::INT "
        "WHEN g[len(g) + 1 - i]::INT > 4 THEN 2 * g[len(g) + 1 - i]::INT - 9 ELSE 2 * g[len(g) + 1 - i]::INT END)) % 10 = 0",
        "phone": "len(g) BETWEEN 9 AND 15",
        "iban": "len(replace(p, ' ', '')) BETWEEN 15 AND 34",
        "ssn": "NOT regexp_matches(p, '^(?:000|666|9)|-00-|-0000$')",
    }
    clear = {
        "iban": "NOT regexp_matches(after, '^[A-Za-z0-9]') AND NOT regexp_matches(before, '[A-Za-z0-9]$')",
        "ssn": r"NOT regexp_matches(after, '^-?[0-9]') AND NOT regexp_matches(before, '[0-9+][\x20.-]?$')",
    }
    clear["local"] = clear["ssn"]
    parts = []
    for i, k in enumerate(KINDS):
        around = f"translate(before || ' ' || chr(10) || ' ' || after, '{ascii_uppercase}', '{ascii_lowercase}')"
        score = f"greatest(0, least(10, {k.score} + 3 * regexp_matches({around}, {quote(k.words)})::INT - 4 * regexp_matches({around}, {quote(k.against)})::INT))"
        test = good.get(k.name, "true") + (f" AND {clear.get(k.name, 'true')} AND {score} >= {LEAST}" if i >= N_BASE else "")
        parts.append(
            f"SELECT r, {i} AS kind, e - len(p) AS s, e, {score} AS score, g, p FROM (SELECT *, regexp_replace(p, '[^0-9]', '', 'g') AS g, sum(len(p)) OVER w AS e, right(coalesce(lag(p) OVER w, ''), {CONTEXT}) AS before, "
            f"left(coalesce(lead(p) OVER w, ''), {CONTEXT}) AS after FROM (SELECT r, unnest(q) AS p, generate_subscripts(q, 1) AS pos FROM "
            f"(SELECT r, string_split(regexp_replace(t, {quote(f'({k.plain})')}, chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS q FROM d) WHERE len(q) > 1) WINDOW w AS (PARTITION BY r ORDER BY pos)) "
            f"WHERE pos % 2 = 0 AND {test}"
        )
    names = "[" + ", ".join(quote(k.name) for k in KINDS) + "]"
    joined = f"string_agg({names}[kind + 1] || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, kind)"
    n = lambda i: f"coalesce(n{i}, 0) AS n_{KINDS[i].name}"
    digits = "list_transform(string_split(replace(p, ' ', '')[5:] || replace(p, ' ', '')[1:4], ''), lambda c: CASE WHEN c BETWEEN 'A' AND 'Z' THEN ascii(c) - 55 ELSE c::INT END)"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, replace(coalesce(text, ''), chr(1), chr(2)) AS t FROM documents),
found AS ({' UNION ALL '.join(parts)}),
spans AS (SELECT * FROM found WHERE kind <> 4 OR list_reduce({digits}, lambda a, c: (CASE WHEN c < 10 THEN a * 10 ELSE a * 100 END + c) % 97) = 1),
per AS (SELECT r, {', '.join(f'count(*) FILTER (WHERE kind = {i}) AS n{i}' for i in range(len(KINDS)))}, {joined} FILTER (WHERE kind < {N_BASE}) AS b, {joined} AS spans, string_agg(score::VARCHAR, ',' ORDER BY s, kind) AS scores FROM spans GROUP BY r)
SELECT doc_id, {', '.join(map(n, range(N_BASE)))}, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores, {', '.join(map(n, range(N_BASE, len(KINDS))))}
FROM d LEFT JOIN per USING (r)
"""
