"""Breadth-first search that changes its direction, with sets of vertices as words of 64 bits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.storage import discard, stored

REPORT = "level int, vertices bigint, edges_out bigint, edges_rest bigint, way string, edges_read bigint"


def word_of(id_: str) -> Column:
    """The word of 64 neighbouring ids that an id lies in."""
    return F.shiftright(id_, 6)


def holds(bits: str, id_: str) -> Column:
    """Whether an id's bit is set in its word; null where there is no word."""
    return F.getbit(bits, F.col(id_).bitwiseAND(F.lit(63))) == 1


def to_words(ids: DataFrame, id_: str = "id") -> DataFrame:
    """(word, bits) of a bag of ids: their set, in one shuffle of words that tasks have combined."""
    bit = F.expr(f"shiftleft(1L, cast({id_} & 63 as int))")
    return ids.groupBy(word_of(id_).alias("word")).agg(F.bit_or(bit).alias("bits"))


def from_words(words: DataFrame) -> DataFrame:
    """(id, other columns) of (word, bits, other columns), a row for each bit."""
    rest = [c for c in words.columns if c not in ("word", "bits")]
    place = F.explode(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda k: F.getbit("bits", k) == 1)).alias("_at")
    return words.select("word", *rest, place).select(F.shiftleft("word", 6).bitwiseOR(F.col("_at").cast("long")).alias("id"), *rest)


def direction_search(edges: DataFrame, starts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(levels, report) of a breadth-first search over edges (src, dst) from all ``starts`` (id).

    levels is (id, level), a row for each vertex reached; starts are at 0, with or without edges.  Null ends
    and starts are ignored, repeats and loops don't matter.  Ids are longs, also negative ones.

    A level goes top-down, over the edges that leave the frontier, unless these outnumber the edges that
    lead to vertices not yet reached.  Then it goes bottom-up: it takes only the edges of the latter kind, and
    an end is reached where the frontier lies on the other side.  Where the search goes on behind such a
    level, what is left of the edges becomes a new and smaller table, which later levels read.  So the few
    levels that hold most of a graph don't carry edges between vertices long known.

    Frontiers and the visited set are tables of (word, bits), 64 ids a row: ends met are made distinct by
    or-ing bits, known ones go by and-ing, and what moves is a sixty-fourth of the ids where ids are dense.
    Levels gather as small tables, merged every eight.

    The report has a row a level: vertices, edges that leave them (edges_out), edges to vertices not reached
    (edges_rest), the way taken ("none": nothing can follow) and how many edges it read.
    """
    spark = edges.sparkSession
    ends = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    links = stored(ends.where("src is not null and dst is not null").distinct(), "links")
    sides = links.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(links.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    deg = stored(sides.groupBy("id").agg(F.sum("o").alias("o"), F.sum("i").alias("i")), "sides")
    rest = deg.agg(F.coalesce(F.sum("i"), F.lit(0))).first()[0]
    first = to_words(starts.select(F.col("id").cast("long").alias("id")).where("id is not null"))
    seen = stored(first.withColumn("level", F.lit(0)), "search")
    fronts, front, level, shrunk, report = [], seen, 0, False, []

    def reached() -> DataFrame:
        """(word, bits, level); the last of ``fronts`` is of ``level``."""
        rows = seen
        for i, f in enumerate(fronts, level - len(fronts) + 1):
            rows = rows.unionByName(f.withColumn("level", F.lit(i)))
        return rows

    def unreached(rows: DataFrame) -> DataFrame:
        """Edges whose end no level holds."""
        known = reached().groupBy(F.col("word").alias("_w")).agg(F.bit_or("bits").alias("_v"))
        return rows.join(known, word_of("dst") == F.col("_w"), "left").where(~F.coalesce(holds("_v", "dst"), F.lit(False))).select("src", "dst")

    while True:
        n, out, into = from_words(front.select("word", "bits")).join(deg, "id", "left").agg(F.count(F.lit(1)), F.coalesce(F.sum("o"), F.lit(0)), F.coalesce(F.sum("i"), F.lit(0))).first()
        if not n:
            break
        rest -= into
        way = "none" if not out or not rest else "bottom-up" if out > rest else "top-down"
        report.append([level, n, out, rest, way, 0])
        if way == "none":
            break
        if level and report[-2][4] == "bottom-up":
            fewer = stored(unreached(links), "links")
            discard(links)
            links, shrunk = fewer, True
        read = unreached(links) if way == "bottom-up" else links
        at = front.select(F.col("word").alias("_w"), F.col("bits").alias("_f"))
        met = read.join(at, word_of("src") == F.col("_w")).where(holds("_f", "src"))
        met = met.groupBy(word_of("dst").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(dst & 63 as int))")).alias("_met"), F.count(F.lit(1)).alias("_edges"))
        known = reached().groupBy("word").agg(F.bit_or("bits").alias("_v"))
        new = F.col("_met").bitwiseAND(F.bitwise_not(F.coalesce("_v", F.lit(0).cast("long"))))
        step = stored(met.join(known, "word", "left").select("word", new.alias("bits"), "_edges"), "front")
        level += 1
        report[-1][5] = rest if way == "bottom-up" else out if not shrunk else step.agg(F.coalesce(F.sum("_edges"), F.lit(0))).first()[0]
        front = step.where("bits <> 0").drop("_edges")
        fronts.append(front)
        if len(fronts) == 8:  # levels stay what they are: the last front is of this one
            whole = stored(reached(), "search")
            for old in [seen, *fronts[:-1]]:  # the last front is read once more
                discard(old)
            seen, fronts = whole, []
    discard(deg)
    discard(links)
    return from_words(reached()), spark.createDataFrame(report, REPORT)
