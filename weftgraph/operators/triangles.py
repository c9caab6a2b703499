"""Exact triangle counts of simple graphs, by interchangeable plans.

All plans work on edges oriented from lower to higher (degree, id), so each triangle s -> t -> w, s -> w
is met once and no vertex starts more than sqrt(2 m) edges.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.operators.edges import block_bits, degrees, oriented, relabel_by_degree, reorder
from weftgraph.storage import dealt_by_part, discard, released, stored

PLANS = ("adjacency", "wedge", "hash", "bitmap", "split", "blocks")
#: Vertices of highest degree whose neighbourhoods are bitmaps in the plan "split": 64 for each column of a row.
SPLIT = 512
#: Targets of a block in the plan "blocks", about.
BLOCK = 1024
#: Wedges of a task in the plans "wedge", "hash" and "bitmap", about.
WEDGES = 4_000_000
#: Targets of all out-lists up to which these are broadcast in the plan "adjacency".
LISTED = 2_000_000
#: Targets whose lists a task holds, and wedges that it looks at, in ``shared``, about.
HELD, SEEN = 2_000_000, 400_000_000
#: Rows of corners of triangles that are counted at a time, about.
SUMMED = 200_000_000


def out_lists(directed: DataFrame) -> DataFrame:
    """(s, nbrs): the targets of each vertex in the order of (degree, id)."""
    ranked = F.sort_array(F.collect_list(F.struct("dt", "t")))
    return directed.groupBy("s").agg(F.transform(ranked, lambda x: x["t"]).alias("nbrs"))


def _dealt(directed: DataFrame, per: int) -> tuple[DataFrame, int, str]:
    """(stored ``out_lists``, into how many tasks their wedges go at about ``per`` wedges each, the type that their
    targets travel as: 32 bits where they fit)."""
    lists = stored(out_lists(directed), "lists")
    size = F.size("nbrs").cast("long")
    total, low, high = lists.agg(F.sum(size * (size - 1)), F.min(F.array_min("nbrs")), F.max(F.array_max("nbrs"))).first()
    kind = "int" if total is not None and -(1 << 31) <= low and high < 1 << 31 else "bigint"
    return lists, max(1, directed.sparkSession.sparkContext.defaultParallelism, -(-int(total or 0) // (2 * per))), kind


def _after(lists: DataFrame) -> DataFrame:
    """(s, t, rest): each edge with the targets of s after t, in one array."""
    left = lists.select("s", "nbrs", F.posexplode("nbrs").alias("at", "t"))
    return left.where(F.col("at") < F.size("nbrs") - 1).select("s", "t", F.slice("nbrs", F.col("at") + 2, F.size("nbrs")).alias("rest"))


def _wedges(lists: DataFrame, n: int, kind: str) -> DataFrame:
    """(s, t, w): pairs of targets of s, t below w in the order, dealt by t.  An edge's wedges travel as one array and
    are rows only where they are closed."""
    sent = _after(lists.repartition(n, "s")).withColumn("rest", F.col("rest").cast(f"array<{kind}>")).repartition(n, "t")
    return sent.select("s", "t", F.explode("rest").alias("w")).withColumn("w", F.col("w").cast("bigint"))


def triangles(directed: DataFrame, hint: str | None = None, per: int = WEDGES) -> DataFrame:
    """(s, t, w): every triangle once, by closing wedges (J2, J8).  Both sides are dealt by t, so inside
    ``dealt_by_part`` the join on (t, w) exchanges no wedge."""
    lists, n, kind = _dealt(directed, per)
    closing = lists.select(F.col("s").alias("t"), "nbrs").repartition(n, "t").select("t", F.explode("nbrs").alias("w"))
    return _wedges(lists, n, kind).join(closing.hint(hint) if hint else closing, ["t", "w"]).select("s", "t", "w")


def intersections(directed: DataFrame) -> DataFrame:
    """(s, t, common): targets that both ends of an edge have, as arrays.

    With targets in order, those of s that t can share lie after t, so only that part travels.  Lists are
    stored: they are made once, and broadcast up to ``LISTED`` targets.  The edges with their parts are many
    times what Spark takes them for, so they are never left to it to broadcast.
    """
    lists = stored(out_lists(directed), "lists")
    few = (lists.agg(F.sum(F.size("nbrs").cast("long"))).first()[0] or 0) <= LISTED
    right = lists.select(F.col("s").alias("t"), F.col("nbrs").alias("theirs"))
    return _after(lists).join(right.hint("broadcast" if few else "merge"), "t").select("s", "t", F.array_intersect("rest", "theirs").alias("common"))


def _places(spark: SparkSession, n: int) -> list[int]:
    """n numbers that go into n different ones of n tasks when rows are dealt by them."""
    found: dict[int, int] = {}
    tried = 0
    while len(found) < n:
        ids = spark.range(tried, tried + 20 * n).select(F.col("id").cast("int").alias("x"))
        for x, task in ids.select("x", F.pmod(F.hash("x"), F.lit(n))).collect():
            found.setdefault(task, x)
        tried += 20 * n
    return [found[i] for i in range(n)]


def _lists(graph: DataFrame) -> DataFrame:
    """Stored ``out_lists`` of clean edges; each exchange is a step of its own, whose files go before the next."""
    deg = stored(degrees(graph), "degrees")
    half = stored(graph.select("u", "v").join(deg.toDF("u", "du"), "u"), "half")
    both = half.join(deg.toDF("v", "dv"), "v")
    first = F.struct("du", "u") < F.struct("dv", "v")
    pick = lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b))
    directed = stored(both.select(pick("u", "v").alias("s"), pick("v", "u").alias("t"), pick("dv", "du").alias("dt")), "oriented")
    discard(half)
    discard(deg)
    lists = stored(out_lists(directed), "lists")
    discard(directed)
    return lists


def shared(lists: DataFrame, held: int | None = None) -> DataFrame:
    """(s, t, common) of stored ``out_lists`` as ``intersections`` has them, for use inside ``dealt_by_part`` only,
    where no wedge is exchanged.

    Tasks hold lists, dealt by t in blocks of neighbouring ids; each s sends its list once to a task that holds one
    of its targets or more, not once for every target.  Where the targets of many s are in many tasks, lists are also cut
    by hash of their targets: tasks are a grid, and of its shapes that which sends least is taken.
    """
    spark = lists.sparkSession
    size = F.size("nbrs").cast("long")
    low, high = F.min(F.least("s", F.array_min("nbrs"))), F.max(F.greatest("s", F.array_max("nbrs")))
    total, wedges, low, high = lists.agg(F.sum(size), F.sum(size * (size - 1) / 2), low, high).first()
    if not total:
        return _after(lists).select("s", "t", F.col("rest").alias("common"))
    kind = "int" if -(1 << 31) <= low and high < 1 << 31 else "bigint"
    n = max(spark.sparkContext.defaultParallelism, -(-total // (held or HELD)), -(-int(wedges) // SEEN))
    k = block_bits(lists.select(F.col("s").alias("id"), size.alias("n")), total // (4 * n))
    row = lambda t, rows: F.pmod(F.xxhash64(F.shiftright(t.cast("bigint"), k)), F.lit(rows)).cast("int")
    col = lambda w, cols: F.pmod(F.xxhash64(w.cast("bigint")), F.lit(cols)).cast("int")
    rows_of = lambda rows: F.array_distinct(F.transform("nbrs", lambda t: row(t, rows)))
    shapes = [(-(-n // cols), cols) for cols in (1 << i for i in range(12)) if cols * cols <= n]
    sent = lists.agg(*[F.sum(size * (F.size(rows_of(r)) + c)) for r, c in shapes]).first()
    rows, cols = min(zip(sent, shapes))[1]
    place = F.get(F.lit(_places(spark, rows * cols)), F.col("_row") * cols + F.col("_col"))
    lists = lists.select(F.col("s").cast(kind).alias("s"), F.col("nbrs").cast(f"array<{kind}>").alias("nbrs"))
    cut = lambda x: x if cols == 1 else F.filter(x, lambda w: col(w, cols) == F.col("_col"))
    each = F.explode(F.sequence(F.lit(0), F.lit(cols - 1))).alias("_col")

    left = lists.select("s", "nbrs", F.explode(rows_of(rows)).alias("_row"))
    left = left.select("s", "nbrs", "_row", F.filter("nbrs", lambda t: row(t, rows) == F.col("_row")).alias("to"))
    # what any target in ``to`` can share lies after the first of them
    left = left.select("s", "_row", "to", F.slice("nbrs", F.array_position("nbrs", F.get("to", F.lit(0))).cast("int"), F.size("nbrs")).alias("nbrs"))
    left = left.select("*", each).select(place.alias("place"), "s", "to", cut(F.col("nbrs")).alias("nbrs")).repartition(rows * cols, "place")
    left = left.where(F.size("nbrs") > 0).select("place", "s", "nbrs", F.explode("to").alias("t"))
    rest = F.slice("nbrs", (F.array_position("nbrs", F.col("t")) + 1).cast("int"), F.size("nbrs")) if cols == 1 else F.col("nbrs")
    right = lists.select(F.col("s").alias("t"), row(F.col("s"), rows).alias("_row"), "nbrs", each)
    right = right.select(place.alias("place"), "t", cut(F.col("nbrs")).alias("theirs")).repartition(rows * cols, "place")
    both = left.select("place", "s", "t", rest.alias("rest")).join(right.hint("shuffle_hash"), ["place", "t"])
    return both.select(F.col("s").cast("bigint").alias("s"), F.col("t").cast("bigint").alias("t"), F.array_intersect("rest", "theirs").cast("array<bigint>").alias("common"))


def _few(graph: DataFrame) -> tuple[DataFrame, bool]:
    """(the stored graph, whether its lists are so few that they are broadcast)."""
    graph = stored(graph.select("u", "v"), "graph")
    return graph, graph.count() <= LISTED


def listed(directed: DataFrame) -> DataFrame:
    """(s, t, w): every triangle once, from the arrays that edges share; no wedge that doesn't close is a row."""
    return intersections(directed).select("s", "t", F.explode("common").alias("w"))


def _summed(graph: DataFrame, corners: Callable[[DataFrame], DataFrame], count: str) -> DataFrame:
    """How often each row of ``corners`` of the rows (s, t, w) occurs; beyond ``SUMMED`` rows, those of a part of the
    keys after another, so that only a part's rows are exchanged at a time."""
    graph, few = _few(graph)
    per = F.count(F.lit(1)).alias(count)
    if few:
        rows = corners(listed(oriented(graph)))
        return rows.groupBy(*rows.columns).agg(per)
    with released(graph.sparkSession) as keep:
        with dealt_by_part(graph.sparkSession):
            common = keep(stored(shared(_lists(graph)).where("size(common) > 0"), "common"))
    n = max(1, -(-3 * (common.agg(F.sum(F.size("common").cast("long"))).first()[0] or 0) // SUMMED))
    rows = corners(common.select("s", "t", F.explode("common").alias("w")))
    if n == 1:
        return rows.groupBy(*rows.columns).agg(per)
    of = F.pmod(F.xxhash64(*rows.columns), F.lit(n))
    parts = [stored(rows.where(of == i).groupBy(*rows.columns).agg(per), "summed") for i in range(n)]
    discard(common)
    return reduce(DataFrame.unionByName, parts)


def bitmap_words(directed: DataFrame, bits: int = 64) -> DataFrame:
    """(s, word, mask): targets as words of ``bits`` bits."""
    at = F.expr(f"shiftleft(1L, cast(t % {bits} as int))")
    return directed.groupBy("s", F.floor(F.col("t") / bits).cast("long").alias("word")).agg(F.bit_or(at).alias("mask"))


def count_bits(directed: DataFrame, per: int = WEDGES) -> DataFrame:
    """(triangles) by looking the targets of s after t up in the words of t (A3, J7); dealt as in ``triangles``."""
    lists, n, kind = _dealt(directed, per)
    words = bitmap_words(lists.repartition(n, "s").select("s", F.explode("nbrs").alias("t"))).withColumnRenamed("s", "t")
    found = _wedges(lists, n, kind).withColumn("word", F.floor(F.col("w") / 64).cast("long")).join(words.hint("shuffle_hash"), ["t", "word"])
    return found.agg(F.coalesce(F.sum(F.getbit("mask", F.pmod("w", F.lit(64)).cast("int")).cast("long")), F.lit(0)).cast("long").alias("triangles"))


def ranked(graph: DataFrame, descending: bool = True) -> DataFrame:
    """(s, t) of clean edges under dense ids by degree, from the end of lower degree to the other; 32-bit ids
    where there are few enough vertices."""
    perm = stored(relabel_by_degree(degrees(graph), descending), "ranks")
    kind = "int" if perm.count() < 1 << 31 else "bigint"
    pair = reorder(graph.select("u", "v"), perm.withColumn("new_id", F.col("new_id").cast(kind)))
    low, high = F.least("u", "v"), F.greatest("u", "v")
    return pair.select((high if descending else low).alias("s"), (low if descending else high).alias("t"))


def split_lists(directed: DataFrame, split: int) -> DataFrame:
    """(s, tail, h0, h1, ...): the targets of ``ranked`` edges, those below ``split`` as words of 64 bits, a column
    each, the others as a sorted array."""
    heads = [F.coalesce(F.bit_or(F.when((F.col("t") >= 64 * i) & (F.col("t") < 64 * (i + 1)), F.expr(f"shiftleft(1L, cast(t - {64 * i} as int))"))), F.lit(0)).cast("long").alias(f"h{i}") for i in range(split // 64)]
    return directed.groupBy("s").agg(F.sort_array(F.collect_list(F.when(F.col("t") >= split, F.col("t")))).alias("tail"), *heads)


def split_sides(directed: DataFrame, split: int) -> tuple[DataFrame, DataFrame]:
    """(edges s -> t with what s has for t to share, what each t has), to meet in t."""
    lists = stored(split_lists(directed, split), "split-lists")
    words = [f"h{i}" for i in range(split // 64)]
    none = F.array().cast(lists.schema["tail"].dataType)
    # only what lies below t can be a target of both: of the words all, of the tail what comes before t
    tails = lists.select("s", *words, "tail", F.posexplode("tail").alias("at", "t")).select("t", *words, F.slice("tail", F.lit(1), F.col("at")).alias("rest"))
    flat = lists.select("s", *words).select("*", F.explode(F.array(*[F.struct(F.lit(64 * i).alias("first"), F.col(w).alias("word")) for i, w in enumerate(words)])).alias("h")) if words else None
    left = tails
    if flat is not None:
        bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.getbit(F.col("h.word"), b) == 1)
        heads = flat.where("h.word <> 0").select(*words, "h.first", F.explode(bits).alias("_bit")).select((F.col("first") + F.col("_bit")).cast(directed.schema["t"].dataType).alias("t"), *words, none.alias("rest"))
        left = tails.unionByName(heads)
    right = lists.select(F.col("s").alias("t"), F.col("tail").alias("theirs"), *[F.col(w).alias(f"o{i}") for i, w in enumerate(words)])
    return left, right


def count_split(directed: DataFrame, split: int) -> DataFrame:
    """(triangles) of ``ranked`` edges by one plan of two parts (A1, J7): common targets among the ``split`` vertices
    of highest degree by AND and bit counts, those of the tail by intersecting arrays."""
    left, right = split_sides(directed, split)
    bits = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"h{i}").bitwiseAND(F.col(f"o{i}"))) for i in range(split // 64)], F.lit(0))
    both = F.when((F.size("rest") > 0) & (F.size("theirs") > 0), F.size(F.array_intersect("rest", "theirs"))).otherwise(0)
    return left.join(right, "t").agg(F.coalesce(F.sum(bits + both), F.lit(0)).cast("long").alias("triangles"))


def _piece(x: Column, level: Column) -> Column:
    """The block of a target at a level: the low bits of its hash, so a block of a level is cut in two by the next."""
    return F.pmod(F.xxhash64(x), F.pow(F.lit(2), level).cast("long")).cast("int")


def out_blocks(directed: DataFrame, block: int = BLOCK) -> DataFrame:
    """(s, level, b, targets, ends, hubs): out-lists of edges (s, t) in 2**level blocks of about ``block`` targets; a
    light vertex has one.  ``ends``: the targets that have targets themselves, without which an edge is in no
    triangle; ``hubs``: those of several blocks, with their levels."""
    out = directed.groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    level = F.when(F.col("n") <= block, 0).otherwise(F.ceil(F.log2(F.col("n") / F.lit(block)))).cast("int")
    levels = stored(out.select("s", level.alias("level")), "levels")
    known = levels.select(F.col("s").alias("t"), F.col("level").alias("lt"))
    rows = directed.select("s", "t").join(known, "t", "left").join(levels, "s").withColumn("b", _piece(F.col("t"), F.col("level")))
    some = lambda test, x: F.collect_list(F.when(test, x))
    ends, hubs = some(F.col("lt").isNotNull(), F.col("t")), some(F.col("lt") > 0, F.struct("t", "lt"))
    return rows.groupBy("s", "level", "b").agg(F.sort_array(F.collect_list("t")).alias("targets"), ends.alias("ends"), hubs.alias("hubs"))


def block_pairs(blocks: DataFrame) -> DataFrame:
    """(s, level, b, ends, hubs, targets): each block of ends of s with each block of its targets; no row is longer
    than two blocks, and a hub's pairs are dealt by both."""
    many = F.pow(F.lit(2), F.col("level")).cast("int")
    light = blocks.where("level = 0").select("s", "level", "b", "ends", "hubs", "targets")
    heavy = blocks.where("level > 0")
    ends = heavy.where(F.size("ends") > 0).select("s", F.col("b").alias("p"), "ends", "hubs", F.explode(F.sequence(F.lit(0), many - 1)).alias("b"))
    targets = heavy.select("s", "level", "b", "targets", F.explode(F.sequence(F.lit(0), many - 1)).alias("p"))
    return light.unionByName(ends.join(targets, ["s", "p", "b"]).select("s", "level", "b", "ends", "hubs", "targets"))


def block_intersections(directed: DataFrame, block: int = BLOCK) -> DataFrame:
    """(s, t, common): targets that both ends of an edge s -> t have, in parts, for edges whose ids go up.

    Out-lists are cut into blocks; an edge's blocks of s meet the blocks of t that hold the same part of
    the hashes.  No list is a row, and no task lists all edges of a hub with all of its targets.
    """
    blocks = stored(out_blocks(directed, block), "blocks")
    pairs = block_pairs(blocks).select("s", "level", "b", "hubs", "targets", F.explode("ends").alias("t"))
    hub = F.get(F.filter("hubs", lambda h: h["t"] == F.col("t")), F.lit(0))
    left = pairs.select("s", "t", "level", "b", F.coalesce(hub["lt"], F.lit(0)).alias("lt"), F.filter("targets", lambda w: w > F.col("t")).alias("rest")).where(F.size("rest") > 0)
    # a block of s lies in one block of t, or is cut into those of t that it has a part in
    coarse = left.where("level >= lt").select("s", "t", F.pmod("b", F.pow(F.lit(2), F.col("lt")).cast("int")).alias("b"), "rest")
    fine = left.where("level < lt").withColumn("b", F.explode(F.array_distinct(F.transform("rest", lambda w: _piece(w, F.col("lt"))))))
    fine = fine.select("s", "t", "b", F.filter("rest", lambda w: _piece(w, F.col("lt")) == F.col("b")).alias("rest"))
    right = blocks.select(F.col("s").alias("t"), "b", F.col("targets").alias("theirs"))
    return coarse.unionByName(fine).join(right, ["t", "b"]).select("s", "t", F.array_intersect("rest", "theirs").alias("common"))


def triangle_count(graph: DataFrame, plan: str = "adjacency", split: int = SPLIT, block: int = BLOCK) -> DataFrame:
    """(triangles) of clean edges (u, v) (A1, A2, A5).

    ``split``, a multiple of 64, is for the plan "split": so many vertices of highest degree are bits.
    ``block`` is for the plan "blocks".
    """
    if plan == "split":
        if split % 64 or split < 0:
            raise ValueError("split is a multiple of 64")
        return count_split(ranked(graph), split)
    if plan == "blocks":
        return block_intersections(ranked(graph, descending=False), block).agg(F.coalesce(F.sum(F.size("common")), F.lit(0)).cast("long").alias("triangles"))
    if plan == "adjacency":
        graph, few = _few(graph)
        if not few:
            with released(graph.sparkSession) as keep, dealt_by_part(graph.sparkSession):
                return keep(stored(shared(_lists(graph)).agg(F.coalesce(F.sum(F.size("common")), F.lit(0)).cast("long").alias("triangles")), "triangles"))
    directed = oriented(graph)
    if plan == "adjacency":
        return intersections(directed).agg(F.coalesce(F.sum(F.size("common")), F.lit(0)).cast("long").alias("triangles"))
    if plan in ("wedge", "hash"):
        with dealt_by_part(graph.sparkSession):
            return stored(triangles(directed, "merge" if plan == "wedge" else "shuffle_hash").agg(F.count(F.lit(1)).alias("triangles")), "triangles")
    if plan == "bitmap":
        with dealt_by_part(graph.sparkSession):
            return stored(count_bits(directed), "triangles")
    raise ValueError(f"plan must be one of {PLANS}")


def triangles_per_vertex(graph: DataFrame) -> DataFrame:
    """(id, triangles) of vertices that are in one."""
    return _summed(graph, lambda rows: rows.select(F.explode(F.array("s", "t", "w")).alias("id")), "triangles")


def edge_support(graph: DataFrame) -> DataFrame:
    """(u, v, support): triangles on each edge that is in one."""
    ends = F.explode(F.array(F.struct(F.col("s").alias("a"), F.col("t").alias("b")), F.struct(F.col("s").alias("a"), F.col("w").alias("b")), F.struct(F.col("t").alias("a"), F.col("w").alias("b"))))
    return _summed(graph, lambda rows: rows.select(ends.alias("e")).select(F.least("e.a", "e.b").alias("u"), F.greatest("e.a", "e.b").alias("v")), "support")


def probe_count(graph: DataFrame) -> DataFrame:
    """(probes): look-ups that a hash-probing count would make (A5): for each edge s -> t whose t has
    targets, the targets of s after t."""
    directed = oriented(graph)
    after = Window.partitionBy("s").orderBy("dt", "t").rowsBetween(1, Window.unboundedFollowing)
    rows = directed.select("s", "t", F.count(F.lit(1)).over(after).alias("later"))
    starts = directed.select(F.col("s").alias("t")).distinct()
    return rows.join(starts, "t", "left_semi").agg(F.coalesce(F.sum("later"), F.lit(0)).cast("long").alias("probes"))


def workload_stats(graph: DataFrame, bits: int = 64) -> DataFrame:
    """(edges, words, merge_length, avg_words, avg_merge): what bitmap and merge plans would visit (A4)."""
    directed = oriented(graph)
    words = bitmap_words(directed, bits).groupBy("s").agg(F.count(F.lit(1)).alias("w"))
    deg = directed.groupBy("s").agg(F.count(F.lit(1)).alias("d"))
    per = deg.join(words, "s")
    a, b = per, per.select(F.col("s").alias("t"), F.col("w").alias("wt"), F.col("d").alias("dt2"))
    rows = directed.select("s", "t").join(a, "s").join(b, "t", "left")
    n = F.count(F.lit(1))
    total, length = F.sum(F.coalesce("wt", F.lit(0))).cast("long"), F.sum(F.col("d") + F.coalesce("dt2", F.lit(0))).cast("long")
    return rows.agg(n.alias("edges"), total.alias("words"), length.alias("merge_length"), (total / n).alias("avg_words"), (length / n).alias("avg_merge"))


def lookup_intersection(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Rows of the small ``left`` that ``right`` has: the small side drives."""
    return left.join(right.select(*on).distinct(), on, "left_semi")
