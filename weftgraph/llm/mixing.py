"""Mixing sources to target weights (operator 1), in DataFrame functions only.

Leaves of a tree domain - language - source hold documents.  A token budget goes down the tree: among
the children of a node it is shared by weight, and what a child can't take (its tokens times
``max_epochs``) goes to its siblings by their weights before any of it is left to nodes further up.
That is exact water filling on integers, by windows over the aggregated tree.

A leaf then reads its documents in seeded epochs: an epoch is all its documents in the order of a hash
of seed, epoch number and id.  The budget is whole epochs and a token prefix of the next one.  The
prefix needs each document's place in its leaf, which comes from the sums of hash buckets before its
own and a running sum within the bucket, so no leaf is ever one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import WORD, only, stored, text_of
from weftgraph.llm.exact_dedup import drop_ids

#: Hash buckets of a leaf, as bits.
BUCKET_BITS = 12
LEAF = ["domain", "language", "source"]


def _weight(level: list[str], weights: dict[tuple[str, ...], int]) -> Column:
    """The node's weight from ``weights``, 1 where it has none."""
    out = F.lit(1)
    for path, w in weights.items():
        if len(path) == len(level):
            hit = F.lit(True)
            for c, v in zip(level, path):
                hit = hit & (F.col(c) == F.lit(v))
            out = F.when(hit, F.lit(w)).otherwise(out)
    return out.cast("long")


def _fill(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """``nodes`` (parent..., name, cap, weight, given) with ``budget``: ``given`` filled in by weight.

    With children in order of cap / weight, a child is full as long as its cap is no more than its
    weighted share of what those before it left.  The others share the rest by weight, rounded down, and
    the last tokens go one each to the largest remainders.
    """
    dec = "decimal(38,0)"
    by = Window.partitionBy(*parent)
    # cap / weight in order, exactly: whole part, then the rest to 19 places
    long = "decimal(19,0)"
    order = by.orderBy(F.expr("cap div weight"), F.expr(f"cast(cap % weight as {long}) / cast(weight as {long})"), name)
    ahead = order.rowsBetween(Window.unboundedPreceding, -1)
    n = nodes.where("weight > 0")
    n = n.withColumn("_caps", F.coalesce(F.sum("cap").over(ahead), F.lit(0))).withColumn("_weights", F.sum("weight").over(by) - F.coalesce(F.sum("weight").over(ahead), F.lit(0)))
    n = n.withColumn("_left", F.greatest(F.col("given") - F.col("_caps"), F.lit(0)))
    n = n.withColumn("_full", F.col("cap").cast(dec) * F.col("_weights") <= F.col("weight").cast(dec) * F.col("_left"))
    # full children come first; after the first that isn't, none is
    n = n.withColumn("_full", F.coalesce(F.min(F.col("_full").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)) == 1)
    used = F.coalesce(F.sum(F.when(F.col("_full"), F.col("cap"))).over(by), F.lit(0))
    open_weight = F.sum(F.when(~F.col("_full"), F.col("weight"))).over(by)
    n = n.withColumn("_rest", F.greatest(F.col("given") - used, F.lit(0))).withColumn("_open", open_weight)
    product = F.col("weight").cast(dec) * F.col("_rest")
    n = n.withColumn("_floor", F.when(~F.col("_full"), F.floor(product / F.col("_open")).cast("long")))
    # decimal division rounds; one step back where it went up
    n = n.withColumn("_floor", F.when(F.col("_floor").cast(dec) * F.col("_open") > product, F.col("_floor") - 1).otherwise(F.col("_floor")))
    n = n.withColumn("_remainder", F.when(~F.col("_full"), product - F.col("_floor").cast(dec) * F.col("_open")))
    n = n.withColumn("_spare", F.col("_rest") - F.sum("_floor").over(by))
    rank = F.row_number().over(by.orderBy(F.col("_full"), F.col("_remainder").desc(), name))
    share = F.col("_floor") + F.when(rank <= F.col("_spare"), 1).otherwise(0)
    n = n.withColumn("budget", F.when(F.col("_full"), F.col("cap")).otherwise(F.least(F.col("cap"), share)).cast("long"))
    return n.select(*nodes.columns, "budget").unionByName(nodes.where("weight <= 0").withColumn("budget", F.lit(0).cast("long")))


def leaf_budgets(leaves: DataFrame, weights: dict[tuple[str, ...], int], max_epochs: int, numerator: int, denominator: int) -> DataFrame:
    """(domain, language, source, tokens, budget) from (domain, language, source, tokens).

    ``weights`` has integer weights by path, of length 1, 2 or 3; others weigh 1, and 0 shuts a node.
    The whole budget is the tokens times numerator / denominator, rounded down, as far as it can be
    taken.
    """
    down = leaves.select(*LEAF, F.col("tokens").cast("long").alias("tokens"))
    down = down.withColumn("cap", F.col("tokens") * F.lit(max_epochs).cast("long"))
    down = down.withColumn("weight", _weight(LEAF, weights)).withColumn("cap", F.when(F.col("weight") > 0, F.col("cap")).otherwise(0))
    mid = down.groupBy("domain", "language").agg(F.sum("cap").alias("cap")).withColumn("weight", _weight(LEAF[:2], weights))
    mid = mid.withColumn("cap", F.when(F.col("weight") > 0, F.col("cap")).otherwise(0))
    top = mid.groupBy("domain").agg(F.sum("cap").alias("cap")).withColumn("weight", _weight(LEAF[:1], weights))
    total = leaves.agg(F.floor(F.coalesce(F.sum("tokens"), F.lit(0)).cast("decimal(38,0)") * numerator / denominator).cast("long").alias("given"))
    domains = _fill(top.crossJoin(F.broadcast(total)).withColumn("_root", F.lit(0)), ["_root"], "domain")  # one row on the other side
    languages = _fill(mid.join(domains.select("domain", F.col("budget").alias("given")), "domain"), ["domain"], "language")
    got = _fill(down.join(languages.select("domain", "language", F.col("budget").alias("given")), ["domain", "language"]), ["domain", "language"], "source")
    return got.select(*LEAF, "tokens", "budget")


def epoch_hash(seed: int, epoch: Column, id_: Column) -> Column:
    """The place of a document in an epoch: 48 bits of MD5, alike in every engine."""
    text = F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), F.coalesce(id_.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")


def mix_sources(
    docs: DataFrame,
    weights: dict[tuple[str, ...], int],
    domain_of: Column,
    max_epochs: int = 4,
    numerator: int = 1,
    denominator: int = 1,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    language_col: str = "lang",
    source_col: str = "source",
) -> DataFrame:
    """One row per row of ``docs``: id, domain, language, source, n_tokens, leaf_budget, whole_epochs,
    prefix_tokens, taken_tokens, kept.

    Tokens are words ``[^\\x20\\x09-\\x0D]+`` of the whole text.  A document is read ``whole_epochs``
    times and then for its first ``prefix_tokens`` tokens: all, none, or at the end of the leaf's budget
    some.  kept says whether anything of it is read; documents without tokens never are.  Null
    languages, sources and domains are the empty string; null texts are empty.  Of repeated ids the
    order in an epoch is by token count, then arbitrary.  An empty table gives an empty result.  Other
    columns are ignored, whatever their names; ``domain_of`` may use the four named columns.
    """
    names = [id_col, text_col, language_col, source_col]
    own = only(docs, *names).select(
        F.col(id_col).alias("_id"),
        F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long").alias("n_tokens"),
        F.coalesce(domain_of, F.lit("")).alias("domain"),
        F.coalesce(F.col(language_col), F.lit("")).alias("language"),
        F.coalesce(F.col(source_col), F.lit("")).alias("source"),
    )
    own = stored(own, "mix", docs)
    leaves = own.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens"))
    plan = leaf_budgets(leaves, weights, max_epochs, numerator, denominator)
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("long")
    plan = plan.withColumn("whole_epochs", whole).withColumn("_prefix", F.col("budget") - F.col("whole_epochs") * F.col("tokens"))
    plan = stored(plan, "mix-plan")
    # a leaf's plan goes to its documents; the hot leaf's side may be split, it is only looked up
    placed = own.join(plan.select(*LEAF, F.col("budget").alias("leaf_budget"), "whole_epochs", "_prefix"), LEAF)
    placed = placed.withColumn("_hash", epoch_hash(seed, F.col("whole_epochs"), F.col("_id")))
    placed = stored(placed.withColumn("_bucket", F.shiftright("_hash", 48 - BUCKET_BITS)), "mix-placed")
    sums = placed.groupBy(*LEAF, "_bucket").agg(F.sum("n_tokens").alias("_n"))
    ahead = Window.partitionBy(*LEAF).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*LEAF, "_bucket", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*LEAF, "_bucket").orderBy("_hash", "_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    ran = placed.withColumn("_run", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(sums, [*LEAF, "_bucket"])
    start = F.col("_before") + F.col("_run")
    prefix = F.least(F.col("n_tokens"), F.greatest(F.col("_prefix") - start, F.lit(0)))
    out = ran.select(F.col("_id").alias(id_col), *LEAF, "n_tokens", "leaf_budget", "whole_epochs", prefix.cast("long").alias("prefix_tokens"))
    out = out.withColumn("taken_tokens", F.col("whole_epochs") * F.col("n_tokens") + F.col("prefix_tokens"))
    return out.withColumn("kept", F.col("taken_tokens") > 0)


#: Leaves whose ends are broadcast at most; beyond that the ids that go are joined by a shuffle.
LEAVES = 1 << 16


def drop_unmixed(docs: DataFrame, weights: dict[tuple[str, ...], int], domain_of: Column, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", language_col: str = "lang", source_col: str = "source", **how) -> DataFrame:
    """``docs``, all columns, without the rows of which ``mix_sources`` reads nothing; ids must be keys.

    What a leaf reads of an epoch is all up to a place in the epoch's order, so a row is judged by its own
    place and its leaf's last one that is read: no row moves.
    """
    found = stored(mix_sources(docs, weights, domain_of, seed=seed, id_col=id_col, text_col=text_col, language_col=language_col, source_col=source_col, **how), "mixed")
    place = lambda epoch, id_: F.struct(epoch_hash(seed, epoch, id_).alias("h"), id_.alias("i"))
    kept = found.where("kept").groupBy(*[F.col(c).alias(f"_weft_{c}") for c in LEAF])
    ends = stored(kept.agg(F.max(place(F.col("whole_epochs"), F.col(id_col))).alias("_weft_end"), F.any_value("whole_epochs").alias("_weft_epoch")), "mix-ends")
    if ends.count() > LEAVES:
        return drop_ids(docs, found.where(~F.col("kept")).select(id_col), id_col)
    leaf = [F.coalesce(c, F.lit("")) for c in (domain_of, F.col(language_col), F.col(source_col))]
    rows = docs.withColumns({f"_weft_{c}": x for c, x in zip(LEAF, leaf)}).where(F.rlike(text_of(text_col), F.lit(WORD)))
    rows = rows.join(F.broadcast(ends), [f"_weft_{c}" for c in LEAF])  # at most LEAVES short rows
    return rows.where(place(F.col("_weft_epoch"), F.col(id_col)) <= F.col("_weft_end")).select(*docs.columns)


def mixing_sql(weights: dict[tuple[str, ...], int], domain_sql: str, max_epochs: int, numerator: int, denominator: int, seed: int) -> str:
    """The same rows in DuckDB's SQL, over ``documents``."""

    def weight(level: list[str]) -> str:
        cases = [f"WHEN {' AND '.join(f"{c} = '{v}'" for c, v in zip(level, path))} THEN {w}" for path, w in weights.items() if len(path) == len(level)]
        return f"CASE {' '.join(cases)} ELSE 1 END" if cases else "1"

    def fill(name: str, nodes: str, parent: str, child: str, keys: str) -> str:
        order = f"PARTITION BY {parent} ORDER BY cap // weight, (cap % weight) / weight, {child}"
        before = f"{order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
        return f"""
{name}_a AS (SELECT *, greatest(given - coalesce(sum(cap) OVER ({before}), 0), 0)::HUGEINT AS l,
               (sum(weight) OVER (PARTITION BY {parent}) - coalesce(sum(weight) OVER ({before}), 0))::HUGEINT AS w FROM ({nodes}) WHERE weight > 0),
{name}_b AS (SELECT *, cap::HUGEINT * w <= weight::HUGEINT * l AS f FROM {name}_a),
{name}_c AS (SELECT *, min(f::INT) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) = 1 AS full_ FROM {name}_b),
{name}_d AS (SELECT *, greatest(given - coalesce(sum(CASE WHEN full_ THEN cap END) OVER (PARTITION BY {parent}), 0), 0)::HUGEINT AS rest,
               (sum(CASE WHEN NOT full_ THEN weight END) OVER (PARTITION BY {parent}))::HUGEINT AS open_ FROM {name}_c),
{name}_e AS (SELECT *, CASE WHEN NOT full_ THEN (weight::HUGEINT * rest) // open_ END AS fl, CASE WHEN NOT full_ THEN (weight::HUGEINT * rest) % open_ END AS rem FROM {name}_d),
{name}_f AS (SELECT *, row_number() OVER (PARTITION BY {parent} ORDER BY full_, rem DESC, {child}) AS rk, rest - sum(fl) OVER (PARTITION BY {parent}) AS spare FROM {name}_e),
{name} AS (SELECT {keys}, (CASE WHEN full_ THEN cap ELSE least(cap, fl + CASE WHEN rk <= spare THEN 1 ELSE 0 END) END)::BIGINT AS budget FROM {name}_f
           UNION ALL SELECT {keys}, 0 FROM ({nodes}) WHERE weight <= 0)"""

    leaf = "domain, language, source"
    h = f"('0x' || substr(md5('{seed}:' || whole_epochs || ':' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT"
    return f"""
WITH own AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS n_tokens, coalesce({domain_sql}, '') AS domain,
             coalesce(lang, '') AS language, coalesce(source, '') AS source FROM documents),
leaf AS (SELECT {leaf}, sum(n_tokens)::BIGINT AS tokens, {weight(LEAF)} AS weight FROM own GROUP BY {leaf}),
down AS (SELECT *, CASE WHEN weight > 0 THEN tokens * {max_epochs} ELSE 0 END AS cap FROM leaf),
mid0 AS (SELECT domain, language, sum(cap)::BIGINT AS c, {weight(LEAF[:2])} AS weight FROM down GROUP BY domain, language),
mid AS (SELECT domain, language, weight, CASE WHEN weight > 0 THEN c ELSE 0 END AS cap FROM mid0),
top AS (SELECT domain, sum(cap)::BIGINT AS cap, {weight(LEAF[:1])} AS weight FROM mid GROUP BY domain),
total AS (SELECT (coalesce(sum(tokens), 0)::HUGEINT * {numerator} // {denominator})::BIGINT AS given FROM leaf),
{fill("domains", "SELECT 0 AS root_, * FROM top, total", "root_", "domain", "domain")},
{fill("languages", "SELECT mid.*, domains.budget AS given FROM mid JOIN domains USING (domain)", "domain", "language", "domain, language")},
{fill("sources", "SELECT down.*, languages.budget AS given FROM down JOIN languages USING (domain, language)", "domain, language", "source", leaf + ", tokens")},
plan AS (SELECT *, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS whole_epochs FROM sources),
placed AS (SELECT own.*, budget AS leaf_budget, whole_epochs, budget - whole_epochs * tokens AS prefix, {h} AS h FROM own JOIN plan USING ({leaf})),
ran AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY {leaf} ORDER BY h, doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM placed),
cut AS (SELECT *, least(n_tokens, greatest(prefix - start, 0))::BIGINT AS prefix_tokens FROM ran)
SELECT doc_id, domain, language, source, n_tokens, leaf_budget, whole_epochs, prefix_tokens,
       whole_epochs * n_tokens + prefix_tokens AS taken_tokens, whole_epochs * n_tokens + prefix_tokens > 0 AS kept FROM cut
"""
