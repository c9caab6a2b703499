"""Quality rules with risk-controlled thresholds (operator 4), in DataFrame functions only.

Rules compare a share of a text (symbols, capitals, ...) to a cutoff.  Cutoffs come from labelled good
documents.  In each stratum and for each rule, cutoffs are tested from the loosest to the tightest: the
hypothesis that a good document is rejected with a chance of ``risk`` / rules or more is dropped if as
few rejections as were seen would then have had a chance, by the exact binomial distribution, of at most
``level`` / (strata * rules).  The first that can't be dropped ends the sequence, so within it no
correction is due (fixed-sequence testing), and across strata and rules Bonferroni's holds.  With
probability 1 - ``level``, then, no stratum loses more than ``risk`` of its good documents to all rules
together.  A rule without a proven cutoff rejects nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import SPACE, WORD, only, stored, text_of

#: Words of a window whose repeats count.
WINDOW = 5
#: Rules as (numerator, denominator) columns; more is worse.
RULES = {"symbols": ("n_symbols", "word_chars"), "capitals": ("n_capitals", "word_chars"), "marks": ("n_marks", "n_words"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words")}
#: Cutoffs in thousandths, from the loosest to the tightest.
CUTOFFS = [900, 700, 500, 400, 300, 250, 200, 150, 120, 100, 80, 60, 50, 40, 30, 20, 10, 5]
_FEATURES = ["n_words", "word_chars", "n_symbols", "n_capitals", "n_marks", "n_lines", "n_dup_lines", "n_repeat_words"]


def _let(value: Column, f) -> Column:
    """``f`` of ``value``, which is worked out once."""
    return F.transform(F.array(value), f)[0]


def repeat_words(words: Column) -> Column:
    """How many words lie in windows of five that the array holds twice or more.

    Windows are compared by 64-bit hashes.  Where all are different that is all; else equal neighbours
    in the sorted (hash, place) pairs are the repeats, and the union of their windows is counted from
    the gaps between their places.
    """

    def of(w: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(w) - WINDOW)
        return _let(F.transform(places, lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(WINDOW)])), count)

    def count(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_let(pairs, union))

    def union(s: Column) -> Column:
        twin = lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])
        at = F.sort_array(F.transform(F.filter(s, lambda x, i: F.coalesce(twin(x, i), F.get(s, i + 1)["h"] == x["h"], F.get(s, i - 1)["h"] == x["h"], F.lit(False))), lambda x: x["i"]))
        zero = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        step = lambda acc, p: F.struct((acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n"), p.alias("last"))
        return F.aggregate(at, zero, step, lambda acc: acc["n"])

    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(_let(words, of)).cast("long")


def features(docs: DataFrame, id_col: str, text_col: str, stratum: Column) -> DataFrame:
    """(_id, _stratum, features...) of whole texts."""
    t = F.col("_text")
    count = lambda pattern: F.regexp_count(t, F.lit(pattern)).cast("long")
    lines = F.filter(F.split(t, "\n"), lambda x: F.rlike(x, F.lit(WORD)))
    own = docs.select(F.col(id_col).alias("_id"), F.coalesce(stratum, F.lit("")).alias("_stratum"), text_of(text_col).alias("_text"))
    words = F.array_remove(F.split(t, SPACE), "")
    return own.select(
        "_id", "_stratum", count(WORD).alias("n_words"), F.length(F.regexp_replace(t, SPACE, "")).cast("long").alias("word_chars"),
        count(r"[#*$%&|<>]").alias("n_symbols"), count(r"\p{Lu}").alias("n_capitals"), count("!").alias("n_marks"),
        _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("_lines"),
        repeat_words(words).alias("n_repeat_words"),
    ).select("*", F.col("_lines.n").alias("n_lines"), F.col("_lines.dup").alias("n_dup_lines")).select("_id", "_stratum", *_FEATURES)


def _lgamma(x: Column) -> Column:
    """log gamma for x >= 1: Stirling's series at x + 8 and the product back."""
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    back = F.log(x)
    for j in range(1, 8):
        back = back + F.log(x + j)
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + series - back


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k) from exact terms; 1 from the mean on, where nothing is to be proven.

    Below the mean terms shrink downwards, and those a dozen standard deviations below k are nothing.
    """
    import math

    mean = n * p
    low = F.greatest(F.lit(0), k - F.ceil(12 * F.sqrt(mean) + 60)).cast("long")
    whole = _lgamma(n.cast("double") + 1)
    term = lambda i: F.exp(whole - _lgamma(i.cast("double") + 1) - _lgamma((n - i).cast("double") + 1) + i * math.log(p) + (n - i) * math.log1p(-p))
    total = F.aggregate(F.sequence(low, k), F.lit(0.0), lambda acc, i: acc + term(i))
    return F.when((n == 0) | (k >= mean), F.lit(1.0)).otherwise(F.least(F.lit(1.0), total))


def thresholds(good: DataFrame, risk: float, level: float) -> DataFrame:
    """(_stratum, <rule>...): the tightest proven cutoff of each rule in thousandths, or null.

    ``good`` has _stratum and the features of labelled good documents.
    """
    rules = [F.struct(F.lit(r).alias("rule"), F.col(a).alias("a"), F.col(b).alias("b")) for r, (a, b) in RULES.items()]
    # per stratum one row: how many, and for each rule and cutoff how many it would reject
    counts = [F.count_if(F.col(a) * 1000 > F.col(b) * c).alias(f"{r}_{c}") for r, (a, b) in RULES.items() for c in CUTOFFS]
    per = good.groupBy("_stratum").agg(F.count(F.lit(1)).alias("n"), *counts)
    strata = per.agg(F.count(F.lit(1)).alias("strata"))
    tests = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(c).alias("cutoff"), F.lit(i).alias("at"), F.col(f"{r}_{c}").alias("k")) for r in RULES for i, c in enumerate(CUTOFFS)])
    rows = per.select("_stratum", "n", F.explode(tests).alias("t")).select("_stratum", "n", "t.*").crossJoin(F.broadcast(strata))  # one row on the other side
    proven = binomial_cdf(F.col("k"), F.col("n"), risk / len(rules)) <= F.lit(level) / (F.col("strata") * len(rules))
    upto = Window.partitionBy("_stratum", "rule").orderBy("at")
    rows = rows.withColumn("_ok", proven.cast("int")).withColumn("_ok", F.min("_ok").over(upto))
    return rows.groupBy("_stratum").agg(*[F.min(F.when((F.col("rule") == r) & (F.col("_ok") == 1), F.col("cutoff"))).alias(f"cut_{r}") for r in RULES])


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", risk: float = 0.05, level: float = 0.05) -> DataFrame:
    """One row per row of ``docs``: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, failed_rules, kept.

    failed_rules lists the rules whose cutoff the text exceeds, comma-joined.  Null and empty texts have
    no words and fail the base.  A null stratum is the stratum ''.  ``labels`` has the id and quality (1:
    good); null ids and qualities are left out, and of repeated labels of an id the smallest counts.
    Repeated documents count and are judged one by one.  A stratum without labels has no cutoffs, and
    its texts are judged by the base alone.  An empty table gives an empty result.  Other columns are
    ignored, whatever their names.
    """
    found = stored(features(only(docs, *dict.fromkeys([id_col, text_col, stratum_col])), id_col, text_col, F.col(stratum_col)), "quality")
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min("quality").alias("q")).where("q = 1").select("_id")
    cuts = stored(thresholds(found.join(marks, "_id", "left_semi"), risk, level), "cuts")  # one row a stratum
    failed = F.filter(F.array(*[F.when(F.col(a) * 1000 > F.col(b) * F.col(f"cut_{r}"), F.lit(r)) for r, (a, b) in RULES.items()]), lambda x: x.isNotNull())
    base = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    out = found.join(cuts, "_stratum", "left").withColumn("failed_rules", F.array_join(failed, ",")).withColumn("base_failed", base)
    shown = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "failed_rules"]
    return out.select(F.col("_id").alias(id_col), *shown, (~F.col("base_failed") & (F.col("failed_rules") == "")).alias("kept"))


def quality_sql(risk: float = 0.05, level: float = 0.05) -> str:
    """The same rows in DuckDB's SQL."""
    p = risk / len(RULES)
    term = f"exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) + i * ln({p!r}) + (n - i) * ln(1 - {p!r}))"
    tests = " UNION ALL ".join(
        f"SELECT s, '{r}' AS rule, c, n, k FROM (SELECT s, c, count(*) AS n, count(*) FILTER (WHERE {a} * 1000 > {b} * c) AS k FROM good, (SELECT unnest({CUTOFFS}) AS c) GROUP BY s, c)" for r, (a, b) in RULES.items()
    )
    cuts = ", ".join(f"min(c) FILTER (WHERE rule = '{r}' AND ok) AS cut_{r}" for r in RULES)
    names = ", ".join(f"CASE WHEN {a} * 1000 > {b} * cut_{r} THEN '{r}' END" for r, (a, b) in RULES.items())
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS s, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '{WORD}') AS w FROM d),
grams AS (SELECT r, i, w[i:i + 4] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM grams) WHERE c > 1),
covered AS (SELECT r, count(DISTINCT i + j) AS n_repeat_words FROM rep, (SELECT unnest(range(0, 5)) AS j) GROUP BY r),
lines AS (SELECT r, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines FROM
          (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l FROM d)),
f AS (SELECT d.doc_id, s, len(w) AS n_words, length(regexp_replace(t, '{SPACE}', '', 'g')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
      len(regexp_extract_all(t, '\p{{Lu}}')) AS n_capitals, len(regexp_extract_all(t, '!')) AS n_marks, n_lines, n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM d JOIN w USING (r) JOIN lines USING (r) LEFT JOIN covered USING (r)),
good AS (SELECT * FROM f WHERE doc_id IN (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1)),
tests AS ({tests}),
proven AS (SELECT *, CASE WHEN k >= n * {p!r} THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1), lambda i: {term})) END
           <= {level!r} / ((SELECT count(DISTINCT s) FROM good) * {len(RULES)}) AS one FROM tests),
seq AS (SELECT *, bool_and(one) OVER (PARTITION BY s, rule ORDER BY c DESC) AS ok FROM proven),
cuts AS (SELECT s, {cuts} FROM seq GROUP BY s),
judged AS (SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
           coalesce(array_to_string(list_filter([{names}], lambda x: x IS NOT NULL), ','), '') AS failed_rules FROM f LEFT JOIN cuts USING (s))
SELECT *, NOT base_failed AND failed_rules = '' AS kept FROM judged
"""
