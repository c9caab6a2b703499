"""Secret scans with multipart credential linking (operator 5), in DataFrame functions only.

Base kinds are found by their patterns alone.  Weak kinds, which are too common to report by themselves,
are parts of a credential: an identifier, a bare secret, an endpoint.  Parts are rows; an interval join
on scope-wide cells links each weak part to the complementary parts of its document that start within
``scope`` code points and don't overlap it, and only linked ones are reported.  The parts of a role in a
cell are one row, so the join makes at most three rows for each part and role.

Positions come without a user function: matches are wrapped in a control character, the text is split
at it, and running sums of the lengths of the pieces are the positions, in code points.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import only, stored, text_of

# The patterns of the base kinds, alike in Java and RE2.
ASSIGN = (
    r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?"
)
VALUE = r"[A-Za-z0-9+/_.=-]+"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
# Patterns of the weak kinds.
IDENTIFIER = r"(?:(?:ASIA|AROA|AIDA)[A-Z0-9]{16,}|(?:client_id|access_key_id|account_id|user(?:name)?)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9_.@-]{4,})"
BARE = r"[A-Za-z0-9+/]{32,}={0,2}"
ENDPOINT = r"(?:https?|ftp|amqp|redis|mongodb|mysql|postgres(?:ql)?)://[^\x20\x09-\x0D\"'<>]+"

#: Kinds in the order of equal starts; the first three are the base.
KINDS = ["assign", "access", "hex", "identifier", "bare", "endpoint"]
PATTERNS = {"assign": ASSIGN + VALUE, "access": ACCESS, "hex": HEX, "identifier": IDENTIFIER, "bare": BARE, "endpoint": ENDPOINT}
#: The part that a kind plays, and the parts of which a weak kind needs one nearby.
ROLE = {"assign": "secret", "access": "identifier", "hex": "secret", "identifier": "identifier", "bare": "secret", "endpoint": "endpoint"}
NEEDS = {"identifier": ["secret"], "bare": ["identifier", "endpoint"], "endpoint": ["secret"]}
#: What any match holds, in lower case; texts without these and without a long run have no spans.
TELLING = ["password", "passwd", "secret", "token", "apikey", "api_key", "akia", "asia", "aroa", "aida", "client_id", "_key_id", "account_id", "user", "://"]
LONG = r"[0-9A-Za-z+/]{24}"
_MARK, _STAND_IN = "\x01", "\x02"


def _good(kind: str, match):
    """Whether a match counts: enough of a value, letters and digits in a bare secret."""
    if kind == "assign":
        return F.length(F.regexp_replace(match, "^" + ASSIGN, "")) >= 6
    if kind == "bare":
        return F.rlike(match, F.lit("[0-9]")) & F.rlike(match, F.lit("[A-Za-z]"))
    return F.lit(True)


def spans(texts: DataFrame) -> DataFrame:
    """(_id, _key, kind, start, end) of all matches in ``texts`` (_id, _key, _text), weak ones included.

    Rows of equal _id and _key are one row.
    """
    clean = texts.dropDuplicates(["_id", "_key"]).select("_id", "_key", F.replace("_text", F.lit(_MARK), F.lit(_STAND_IN)).alias("_text"))
    # pieces alternate: between matches, match, between, ...

    def pieces(i: int, kind: str):
        parts = F.split(F.regexp_replace("_text", f"({PATTERNS[kind]})", f"{_MARK}$1{_MARK}"), _MARK)
        hits = F.transform(parts, lambda p, at: F.struct(F.length(p).alias("n"), ((at % 2 == 1) & _good(kind, p)).alias("hit")))
        return F.struct(F.lit(i).alias("kind"), hits.alias("pieces"))

    rows = clean.select("_id", "_key", F.explode(F.array(*[pieces(i, k) for i, k in enumerate(KINDS)])).alias("k")).where(F.size("k.pieces") > 1)
    rows = rows.select("_id", "_key", F.col("k.kind").alias("kind"), F.posexplode("k.pieces").alias("at", "p"))
    upto = Window.partitionBy("_id", "_key", "kind").orderBy("at")
    ends = rows.select("_id", "_key", "kind", "p.hit", "p.n", F.sum("p.n").over(upto).alias("end"))
    return ends.where("hit").select("_id", "_key", "kind", (F.col("end") - F.col("n")).cast("long").alias("start"), F.col("end").cast("long"))


def _pick(d: dict):
    """The value of ``d`` (strings, or lists of them) for the row's kind."""
    value = lambda v: F.lit(v) if isinstance(v, str) else F.array(*map(F.lit, v))
    return F.coalesce(*[F.when(F.col("kind") == KINDS.index(k), value(v)) for k, v in d.items()])


def parts(found: DataFrame) -> DataFrame:
    """``found`` without what is no part of its own: weak spans that start where a base span starts, and
    identifiers and bare secrets that lie inside a base span or an endpoint."""
    outer = F.when((F.col("kind") < 3) | (F.col("kind") == KINDS.index("endpoint")), F.col("end"))
    base = F.when(F.col("kind") < 3, F.col("start"))
    upto = Window.partitionBy("_id", "_key").orderBy("start")  # equal starts count
    rows = found.withColumn("_reach", F.max(outer).over(upto)).withColumn("_base", F.max(base).over(upto))
    inner = F.col("kind").isin(KINDS.index("identifier"), KINDS.index("bare"))
    gone = (F.col("kind") >= 3) & (F.coalesce(F.col("_base") == F.col("start"), F.lit(False)) | (inner & F.coalesce(F.col("_reach") >= F.col("end"), F.lit(False))))
    return rows.where(~gone).select(*found.columns)


def link(found: DataFrame, scope: int) -> DataFrame:
    """The base spans of ``found`` and the weak ones that a complementary part accompanies: one that starts
    within ``scope`` code points and doesn't overlap.

    Parts of a role in a cell of ``scope`` code points are one row; spans of a kind don't overlap, so a
    cell holds a bounded number of them, and a part meets three cells for each role that it needs.
    """
    cell = F.floor(F.col("start") / F.lit(scope)).cast("long")
    cells = found.groupBy(F.col("_id").alias("_cid"), F.col("_key").alias("_ckey"), _pick(ROLE).alias("_crole"), cell.alias("_ccell")).agg(F.collect_list(F.struct("start", "end")).alias("_theirs"))
    weak = found.where(F.col("kind") >= 3)
    asks = weak.withColumn("_role", F.explode(_pick(NEEDS))).withColumn("_cell", F.explode(F.array(cell - 1, cell, cell + 1)))
    met = asks.join(cells, asks["_id"].eqNullSafe(cells["_cid"]) & (asks["_key"] == cells["_ckey"]) & (asks["_role"] == cells["_crole"]) & (asks["_cell"] == cells["_ccell"]))
    near = F.exists("_theirs", lambda o: (F.abs(o["start"] - F.col("start")) <= scope) & ((o["end"] <= F.col("start")) | (o["start"] >= F.col("end"))))
    return found.where(F.col("kind") < 3).unionByName(met.where(near).select(*found.columns).distinct())


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 200) -> DataFrame:
    """One row per row of ``docs``: id, n_assign, n_access, n_hex, base_sha256, spans, n_linked.

    Spans are ``kind:start:end`` in code points, end exclusive, by start and then kind, comma-joined;
    base_sha256 is of the base kinds' spans, n_linked counts the others.  Null and empty texts have none;
    very long ones are read whole.
    Repeated rows get the same result; null ids are kept.  An empty table gives an empty result.  Other
    columns are ignored, whatever their names.
    """
    own = only(docs, id_col, text_col).select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    low = F.lower("_text")
    told = reduce(lambda x, y: x | y, [F.contains(low, F.lit(t)) for t in TELLING]) | F.rlike("_text", F.lit(LONG))
    # one pass over all texts keeps what may hold something; another makes the spans, which are read several times
    own = own.withColumn("_told", told).select("_id", F.when(F.col("_told"), F.xxhash64("_text")).alias("_key"), F.when(F.col("_told"), F.col("_text")).alias("_text"))
    own = stored(own, "secrets")
    found = link(stored(parts(spans(own.where(F.col("_key").isNotNull()))), "spans"), scope)
    per = found.groupBy("_id", "_key").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("s"))
    name = lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1), x["start"], x["end"])
    text = lambda s: F.array_join(F.transform(s, name), ",")
    many = lambda test: F.size(F.filter("s", test)).cast("long")
    of_kind = lambda i: lambda x: x["kind"] == i
    per = per.select(
        F.col("_id").alias("_sid"), F.col("_key").alias("_skey"),
        *[many(of_kind(i)).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])],
        text(F.filter("s", lambda x: x["kind"] < 3)).alias("_base"), text(F.col("s")).alias("spans"), many(lambda x: x["kind"] >= 3).alias("n_linked"),
    )
    rows = own.select("_id", "_key")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.join(per, rows["_id"].eqNullSafe(per["_sid"]) & (rows["_key"] == per["_skey"]), "left").select(
        F.col("_id").alias(id_col), zero("n_assign"), zero("n_access"), zero("n_hex"),
        F.sha2(F.coalesce("_base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), zero("n_linked"),
    )


def secret_sql(scope: int = 200) -> str:
    """The same rows in DuckDB's SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    good = {"assign": f"len(regexp_replace(p, {quote('^' + ASSIGN)}, '')) >= 6", "bare": "regexp_matches(p, '[0-9]') AND regexp_matches(p, '[A-Za-z]')"}
    parts = " UNION ALL ".join(
        f"SELECT r, {i} AS kind, pos, p, pos % 2 = 0 AND ({good.get(k, 'true')}) AS hit FROM (SELECT r, unnest(s) AS p, generate_subscripts(s, 1) AS pos FROM "
        f"(SELECT r, string_split(regexp_replace(t, {quote(f'({PATTERNS[k]})')}, chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS s FROM told) WHERE len(s) > 1)"
        for i, k in enumerate(KINDS)
    )
    role = "CASE kind " + " ".join(f"WHEN {i} THEN '{ROLE[k]}'" for i, k in enumerate(KINDS)) + " END"
    needs = " OR ".join(f"(w.kind = {KINDS.index(k)} AND o.role IN ({', '.join(map(quote, v))}))" for k, v in NEEDS.items())
    names = "[" + ", ".join(map(quote, KINDS)) + "]"
    gate = "(?i)" + "|".join([*TELLING, LONG])
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
told AS (SELECT r, replace(t, chr(1), chr(2)) AS t FROM d WHERE regexp_matches(t, {quote(gate)})),
parts AS ({parts}),
ends AS (SELECT r, kind, hit, len(p) AS n, sum(len(p)) OVER (PARTITION BY r, kind ORDER BY pos) AS e FROM parts),
spans AS (SELECT r, kind, {role} AS role, (e - n)::BIGINT AS s, e::BIGINT AS e FROM ends WHERE hit),
found AS (SELECT * FROM spans w WHERE kind < 3 OR NOT EXISTS (SELECT 1 FROM spans b WHERE b.r = w.r AND (b.kind < 3 AND b.s = w.s OR w.kind IN (3, 4) AND (b.kind < 3 OR b.kind = 5) AND b.s <= w.s AND b.e >= w.e))),
kept AS (SELECT r, kind, s, e FROM found WHERE kind < 3 UNION ALL
         SELECT r, kind, s, e FROM found w WHERE kind >= 3
         AND EXISTS (SELECT 1 FROM found o WHERE o.r = w.r AND abs(o.s - w.s) <= {scope} AND (o.e <= w.s OR o.s >= w.e) AND ({needs}))),
per AS (SELECT r, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
        string_agg({names}[kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind) FILTER (WHERE kind < 3) AS b,
        string_agg({names}[kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind) AS spans, count(*) FILTER (WHERE kind >= 3) AS n_linked FROM kept GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(n_linked, 0) AS n_linked FROM d LEFT JOIN per USING (r)
"""
