"""Graphs and matrices made from the driver's tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators.edges import both_directions, clean

#: Rows of a task where rows of an order meet, about; each makes some five pairs.
PER_TASK = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tasks(rows: DataFrame) -> int:
    """Into how many tasks a self-join of ``rows`` (a scan, whose count reads no column) and what is made from it go."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // PER_TASK))


def _meet(rows: DataFrame, key: str, left: dict[str, str], right: dict[str, str], once: bool = False) -> tuple[DataFrame, int]:
    """(rows of the same ``key`` side by side, the number of their tasks), columns renamed for each side.

    Rows are dealt by key into as many tasks as their number asks for, since pairs are a multiple of the rows
    and adaptive execution sizes tasks by what goes in.  ``once``: each distinct row of a key counts once.
    """
    names, n = {**left, **right}, _tasks(rows)
    dealt = rows.select(key, *dict.fromkeys(names.values())).repartition(n, key)
    dealt = dealt.distinct() if once else dealt
    a, b = (dealt.select(key, *[F.col(c).alias(x) for x, c in side.items()]) for side in (left, right))
    return a.join(b.hint("merge"), key), n


def _pairs(spark: SparkSession, sf_dir: str, key: str, once: bool = False) -> tuple[DataFrame, int]:
    return _meet(table(spark, sf_dir, "lineitem"), "l_orderkey", {"src": key}, {"dst": key}, once)


def _simple(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    """``clean`` pairs, made distinct in as many tasks as they come from."""
    rows, n = _pairs(spark, sf_dir, key, once=True)
    return clean(rows.select("src", "dst").where("src < dst").repartition(n, "src", "dst"))


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of parts in one order: loops, both directions, repeats."""
    return _pairs(spark, sf_dir, "l_partkey")[0].select("src", "dst")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _simple(spark, sf_dir, "l_partkey")


def parts_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return both_directions(parts(spark, sf_dir))


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _simple(spark, sf_dir, "l_suppkey")


def strong(spark: SparkSession, sf_dir: str, least: int = 2) -> DataFrame:
    """Parts that are together in several orders."""
    rows, n = _pairs(spark, sf_dir, "l_partkey", once=True)
    rows = rows.where("src < dst").select("src", "dst").repartition(n, "src", "dst")
    return rows.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select(F.col("src").alias("u"), F.col("dst").alias("v"))


def weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, w) of all pairs, both directions, w the number of orders."""
    rows, n = _pairs(spark, sf_dir, "l_partkey", once=True)
    rows = rows.where("src < dst").select("src", "dst").repartition(n, "src", "dst").groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("w"))
    ways = F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    return rows.select(ways.alias("e"), "w").select("e.src", "e.dst", "w")


def priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, w) of all pairs, both directions, w from 1 to 10,000 by the greatest product of their prices in whole units."""
    items = table(spark, sf_dir, "lineitem").withColumn("_p", F.floor("l_extendedprice").cast("long"))
    rows, n = _meet(items, "l_orderkey", {"src": "l_partkey", "p": "_p"}, {"dst": "l_partkey", "q": "_p"}, once=True)
    rows = rows.where("src <> dst").select("src", "dst", (F.col("p") * F.col("q")).alias("_x")).repartition(n, "src", "dst").groupBy("src", "dst").agg(F.max("_x").alias("x"))
    return rows.select("src", "dst", (F.col("x") % 10_000 + 1).cast("double").alias("w"))


def in_line_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries part x part, the number of orders in which the one part's line is not behind the other's:
    all pairs, many one way only, with unequal values."""
    rows, n = _meet(table(spark, sf_dir, "lineitem"), "l_orderkey", {"row": "l_partkey", "n1": "l_linenumber"}, {"col": "l_partkey", "n2": "l_linenumber"}, once=True)
    rows = rows.where("row <> col and n1 <= n2").select("l_orderkey", "row", "col").distinct()
    return rows.select("row", "col").repartition(n, "row", "col").groupBy("row", "col").agg(F.count(F.lit(1)).cast("double").alias("val"))


def _bought(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their lines; packed keys look small enough to broadcast when they aren't."""
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem").hint("merge"), F.col("o_orderkey") == F.col("l_orderkey"))


def bipartite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers who meet in an order; suppliers' ids lie above."""
    rows = _bought(spark, sf_dir)
    return clean(rows.select(F.col("o_custkey").alias("src"), (F.col("l_suppkey") + 10_000_000_000).alias("dst")))


def cust_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries customer x part, the quantity bought."""
    rows = _bought(spark, sf_dir)
    return rows.groupBy(F.col("o_custkey").alias("row"), F.col("l_partkey").alias("col")).agg(F.sum("l_quantity").alias("val"))


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries document x word, the number of times."""
    words = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row"), F.explode(F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"))).alias("col"))
    return words.groupBy("row", "col").agg(F.count(F.lit(1)).cast("double").alias("val"))


def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row"), F.posexplode("embedding").alias("col", "val"))
    return rows.select("row", F.col("col").cast("long").alias("col"), F.col("val").cast("double").alias("val"))


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("tid"), F.col("l_suppkey").alias("item")).distinct()


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tid, item): orders and the nations of their suppliers."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.select(F.col("l_orderkey").alias("tid"), F.col("s_nationkey").alias("item"))


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(F.col("doc_id").alias("key"), F.col("n_chars").alias("score"), F.col("quality").alias("label"))


def tensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, i, j, v): nation of the customer, part, supplier, quantity."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = o.join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.select(F.col("c_nationkey").cast("long").alias("k"), F.col("l_partkey").alias("i"), F.col("l_suppkey").alias("j"), F.col("l_quantity").alias("v"))


RAW = "raw AS (SELECT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b USING (l_orderkey))"
E = RAW + ", e AS (SELECT DISTINCT least(src, dst) AS u, greatest(src, dst) AS v FROM raw WHERE src <> dst)"
DEG = "deg AS (SELECT id, count(*) AS degree FROM (SELECT u AS id FROM e UNION ALL SELECT v FROM e) GROUP BY id)"
ORIENTED = (
    DEG + ", o AS (SELECT CASE WHEN (du.degree, u) < (dv.degree, v) THEN u ELSE v END AS s, CASE WHEN (du.degree, u) < (dv.degree, v) THEN v ELSE u END AS t, "
    "CASE WHEN (du.degree, u) < (dv.degree, v) THEN du.degree ELSE dv.degree END AS ds, CASE WHEN (du.degree, u) < (dv.degree, v) THEN dv.degree ELSE du.degree END AS dt "
    "FROM e JOIN deg du ON du.id = u JOIN deg dv ON dv.id = v)"
)
TRI = ORIENTED + ", tri AS (SELECT a.s, a.t, b.t AS w FROM o a JOIN o b ON a.s = b.s AND (a.dt, a.t) < (b.dt, b.t) JOIN o c ON c.s = a.t AND c.t = b.t)"
BOTH = "b AS (SELECT u AS src, v AS dst FROM e UNION ALL SELECT v, u FROM e)"
SUPP = "e AS (SELECT DISTINCT least(a.l_suppkey, b.l_suppkey) AS u, greatest(a.l_suppkey, b.l_suppkey) AS v FROM lineitem a JOIN lineitem b USING (l_orderkey) WHERE a.l_suppkey <> b.l_suppkey)"
STRONG = "e AS (SELECT src AS u, dst AS v FROM (SELECT DISTINCT l_orderkey, a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b USING (l_orderkey) WHERE a.l_partkey < b.l_partkey) GROUP BY 1, 2 HAVING count(*) >= 2)"
WEIGHTED = "wt AS (SELECT src, dst, count(*)::DOUBLE AS w FROM (SELECT DISTINCT l_orderkey, a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b USING (l_orderkey) WHERE a.l_partkey <> b.l_partkey) GROUP BY 1, 2)"
PRICED = "wt AS (SELECT src, dst, (max(p * q) % 10000 + 1)::DOUBLE AS w FROM (SELECT a.l_partkey AS src, b.l_partkey AS dst, floor(a.l_extendedprice)::BIGINT AS p, floor(b.l_extendedprice)::BIGINT AS q FROM lineitem a JOIN lineitem b USING (l_orderkey) WHERE a.l_partkey <> b.l_partkey) GROUP BY 1, 2)"
LINE_ORDER = "m AS (SELECT r, c, count(*)::DOUBLE AS v FROM (SELECT DISTINCT l_orderkey, a.l_partkey AS r, b.l_partkey AS c FROM lineitem a JOIN lineitem b USING (l_orderkey) WHERE a.l_partkey <> b.l_partkey AND a.l_linenumber <= b.l_linenumber) GROUP BY 1, 2)"
BIP = "e AS (SELECT DISTINCT o_custkey AS u, l_suppkey + 10000000000 AS v FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"
M = "m AS (SELECT o_custkey AS r, l_partkey AS c, sum(l_quantity) AS v FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2)"
TERMS = r"m AS (SELECT doc_id AS r, w AS c, count(*)::DOUBLE AS v FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w FROM documents) GROUP BY 1, 2)"
EMB = "m AS (SELECT vec_id AS r, (p - 1)::BIGINT AS c, v::DOUBLE AS v FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS p FROM embeddings))"
TX = "tx AS (SELECT DISTINCT l_orderkey AS tid, l_suppkey AS item FROM lineitem)"
NATIONS = "tx AS (SELECT DISTINCT l_orderkey AS tid, s_nationkey AS item FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"
RANKED = "r AS (SELECT doc_id AS key, n_chars AS score, quality AS label FROM documents JOIN labels USING (doc_id))"
