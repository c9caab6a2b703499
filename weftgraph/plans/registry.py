"""All queries of the library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions import bitmaps, blas, scalars
from weftgraph.operators import components, edges, graph, matrix, metrics, mining, ordering, packed, similarity, triangles
from weftgraph.plans import fixtures as fx
from weftgraph.plans import source_queries
from weftgraph.session import reach
from weftgraph.sources import results
from weftgraph.storage import stored

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _add(name: str, query: Query, sql: str | None = None) -> None:
    _QUERIES[name] = lambda spark, sf_dir: query(reach(spark), sf_dir)
    if sql is not None:
        _SQL[name] = sql


def _r(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


# --- edge lists -----------------------------------------------------------------------------------
_add("canonical_edges", lambda s, d: edges.canonical(fx.raw(s, d)).groupBy("u", "v").agg(F.count(F.lit(1)).alias("copies")), f"WITH {fx.RAW} SELECT least(src, dst) AS u, greatest(src, dst) AS v, count(*) AS copies FROM raw GROUP BY 1, 2")
_add("clean_edges", lambda s, d: fx.parts(s, d), f"WITH {fx.E} SELECT u, v FROM e")
_add("max_ids", lambda s, d: edges.max_ids(fx.raw(s, d)), f"WITH {fx.RAW} SELECT max(greatest(src, dst)) AS max_id, max(greatest(src, dst)) + 1 AS n_dense FROM raw")
_add("num_vertices_observed", lambda s, d: edges.num_vertices(fx.raw(s, d), "observed"), f"WITH {fx.RAW} SELECT count(DISTINCT id) AS n FROM (SELECT src AS id FROM raw UNION ALL SELECT dst FROM raw)")
_add("degree", lambda s, d: edges.degrees(fx.parts(s, d)), f"WITH {fx.E}, {fx.DEG} SELECT id, degree FROM deg")
_add("degree_filtered", lambda s, d: edges.degrees(fx.parts(s, d), F.col("u") % 2 == 0), f"WITH {fx.E} SELECT id, count(*) AS degree FROM (SELECT u AS id FROM e WHERE u % 2 = 0 UNION ALL SELECT v FROM e WHERE u % 2 = 0) GROUP BY id")
_add("degree_histogram", lambda s, d: edges.histogram(edges.degrees(fx.parts(s, d)), F.col("degree")), f"WITH {fx.E}, {fx.DEG} SELECT degree AS bucket, count(*) AS n FROM deg GROUP BY 1")
_add("oriented_edges", lambda s, d: edges.oriented(fx.parts(s, d)), f"WITH {fx.E}, {fx.ORIENTED} SELECT s, t, ds, dt FROM o")
_add("oriented_outdegree", lambda s, d: edges.out_degrees(edges.oriented(fx.parts(s, d))), f"WITH {fx.E}, {fx.ORIENTED} SELECT s, count(*) AS out_degree FROM o GROUP BY s")
_add("both_directions", lambda s, d: fx.parts_both(s, d), f"WITH {fx.E}, {fx.BOTH} SELECT src, dst FROM b")
_add("adjacency_lists", lambda s, d: edges.adjacency(fx.parts(s, d)), f"WITH {fx.E}, {fx.BOTH} SELECT src AS id, list(dst ORDER BY dst) AS nbrs FROM b GROUP BY src")
_add("csr_offsets", lambda s, d: edges.csr_offsets(edges.degrees(fx.parts(s, d))), f"WITH {fx.E}, {fx.DEG} SELECT id, degree, coalesce(sum(degree) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begin FROM deg")
_add("prefix_sum", lambda s, d: ordering.running_sum(edges.degrees(fx.parts(s, d)), F.col("degree"), "id"), f"WITH {fx.E}, {fx.DEG} SELECT id, degree, sum(degree) OVER (ORDER BY id)::BIGINT AS running FROM deg")
_add("flag_prefix_sum", lambda s, d: ordering.running_sum(edges.degrees(fx.parts(s, d)), (F.col("degree") > 100).cast("long"), "id"), f"WITH {fx.E}, {fx.DEG} SELECT id, degree, sum((degree > 100)::BIGINT) OVER (ORDER BY id)::BIGINT AS running FROM deg")
_add("relabel_deg_desc", lambda s, d: edges.relabel_by_degree(edges.degrees(fx.parts(s, d))), f"WITH {fx.E}, {fx.DEG} SELECT id AS old_id, row_number() OVER (ORDER BY degree DESC, id) - 1 AS new_id FROM deg")
_add("relabel_deg_asc", lambda s, d: edges.relabel_by_degree(edges.degrees(fx.parts(s, d)), False), f"WITH {fx.E}, {fx.DEG} SELECT id AS old_id, row_number() OVER (ORDER BY degree, id) - 1 AS new_id FROM deg")


def _reordered(s: SparkSession, d: str) -> DataFrame:
    g = fx.parts(s, d)
    return edges.canonical(edges.reorder(g, edges.relabel_by_degree(edges.degrees(g))), "u", "v")


_add("reorder_graph", _reordered, f"WITH {fx.E}, {fx.DEG}, p AS (SELECT id, row_number() OVER (ORDER BY degree DESC, id) - 1 AS n FROM deg) SELECT least(a.n, b.n) AS u, greatest(a.n, b.n) AS v FROM e JOIN p a ON a.id = u JOIN p b ON b.id = v")
_add("extract_subgraph", lambda s, d: edges.extract_subgraph(fx.parts_both(s, d), 50, 100), f"WITH {fx.E}, {fx.BOTH} SELECT src - 50 AS src, dst FROM b WHERE src BETWEEN 50 AND 149")
_add("degree_skew", lambda s, d: _r(edges.degree_skew(edges.degrees(fx.parts(s, d)), 32768, 16), "share"), f"WITH {fx.E}, {fx.DEG}, k AS (SELECT row_number() OVER w AS rank, sum(degree) OVER w AS cumulative FROM deg WINDOW w AS (ORDER BY degree DESC, id)) SELECT rank, cumulative::BIGINT AS cumulative, round(cumulative::DOUBLE / (SELECT count(*) FROM e), 6) AS share FROM k WHERE rank % 16 = 0 AND rank <= 32768")
_add("group_ids", lambda s, d: edges.group_ids(fx.table(s, d, "customer"), "c_nationkey", "c_custkey"), 'SELECT c_nationkey AS "set", list(c_custkey ORDER BY c_custkey) AS ids FROM customer GROUP BY 1')
_add("bucket_sort", lambda s, d: ordering.with_rank(edges.degrees(fx.parts(s, d)), "degree", "id", name="place"), f"WITH {fx.E}, {fx.DEG} SELECT id, degree, row_number() OVER (ORDER BY degree, id) - 1 AS place FROM deg")
_add("bucket_ranges", lambda s, d: ordering.range_overlaps(edges.range_buckets(edges.degrees(fx.parts(s, d)), "degree", 16), "degree"), f"WITH {fx.E}, {fx.DEG} SELECT count(*) AS rows, 0::BIGINT AS overlaps, 0::BIGINT AS descents FROM deg")
_add("sortedness", lambda s, d: ordering.is_sorted(edges.degrees(fx.parts(s, d)), "id", "degree"), f"WITH {fx.E}, {fx.DEG} SELECT count(*) AS violations FROM (SELECT degree < lag(degree) OVER (ORDER BY id) AS x FROM deg) WHERE x")
_add("layered_graph", lambda s, d: matrix.layered_graph(fx.suppliers(s, d), 3, 10_000), f"WITH {fx.SUPP}, {fx.BOTH}, k AS (SELECT unnest(range(3)) AS c), j AS (SELECT unnest(range(2)) AS c), l AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS ps FROM b), up AS (SELECT src + c * 10000 AS src, dst + (c + 1) * 10000 AS dst FROM l, j WHERE (ps + c) % 2 = 0 UNION ALL SELECT id + c * 10000, id + (c + 1) * 10000 FROM (SELECT DISTINCT src AS id FROM b), j) SELECT src + c * 10000 AS src, dst + c * 10000 AS dst FROM b, k UNION ALL SELECT src, dst FROM up UNION ALL SELECT dst, src FROM up")

# --- triangles ------------------------------------------------------------------------------------
_COUNT = f"WITH {fx.E}, {fx.TRI} SELECT count(*) AS triangles FROM tri"
_add("triangle_count", lambda s, d: triangles.triangle_count(fx.parts(s, d)), _COUNT)
for _plan in ("wedge", "hash", "bitmap", "split", "blocks"):
    _add(f"triangle_count_{_plan}", lambda s, d, plan=_plan: triangles.triangle_count(fx.parts(s, d), plan), _COUNT)
for _split in (64, 2048):
    _add(f"triangle_count_split_{_split}", lambda s, d, n=_split: triangles.triangle_count(fx.parts(s, d), "split", split=n), _COUNT)
_add("triangles_per_vertex", lambda s, d: triangles.triangles_per_vertex(fx.parts(s, d)), f"WITH {fx.E}, {fx.TRI} SELECT id, count(*) AS triangles FROM (SELECT s AS id FROM tri UNION ALL SELECT t FROM tri UNION ALL SELECT w FROM tri) GROUP BY id")
_add("edge_support", lambda s, d: triangles.edge_support(fx.parts(s, d)), f"WITH {fx.E}, {fx.TRI} SELECT least(a, b) AS u, greatest(a, b) AS v, count(*) AS support FROM (SELECT s AS a, t AS b FROM tri UNION ALL SELECT s, w FROM tri UNION ALL SELECT t, w FROM tri) GROUP BY 1, 2")
_add("probe_count", lambda s, d: triangles.probe_count(fx.parts(s, d)), f"WITH {fx.E}, {fx.ORIENTED} SELECT count(*) AS probes FROM o a JOIN o b ON a.s = b.s AND (a.dt, a.t) < (b.dt, b.t) WHERE a.t IN (SELECT s FROM o)")
_add("workload_stats", lambda s, d: _r(triangles.workload_stats(fx.parts(s, d)), "avg_words", "avg_merge"), f"WITH {fx.E}, {fx.ORIENTED}, p AS (SELECT s, count(*) AS d, count(DISTINCT t // 64) AS w FROM o GROUP BY s) SELECT count(*) AS edges, sum(coalesce(b.w, 0))::BIGINT AS words, sum(a.d + coalesce(b.d, 0))::BIGINT AS merge_length, round(sum(coalesce(b.w, 0))::DOUBLE / count(*), 6) AS avg_words, round(sum(a.d + coalesce(b.d, 0))::DOUBLE / count(*), 6) AS avg_merge FROM o JOIN p a ON a.s = o.s LEFT JOIN p b ON b.s = o.t")
_add("bitmap_words", lambda s, d: triangles.bitmap_words(edges.oriented(fx.parts(s, d)), 32), f"WITH {fx.E}, {fx.ORIENTED} SELECT s, t // 32 AS word, bit_or(1::BIGINT << (t % 32)::INT) AS mask FROM o GROUP BY 1, 2")
_add("neighbour_intersection", lambda s, d: triangles.intersections(edges.oriented(fx.parts(s, d))).where("size(common) > 0").select("s", "t", F.size("common").cast("long").alias("n")), f"WITH {fx.E}, {fx.TRI} SELECT s, t, count(*) AS n FROM tri GROUP BY s, t")
_add("complete_graph_triangles", lambda s, d: triangles.triangle_count(fx.suppliers(s, d)), f"WITH {fx.SUPP}, {fx.TRI} SELECT count(*) AS triangles FROM tri")
_add("bipartite_triangles", lambda s, d: triangles.triangle_count(fx.bipartite(s, d)), f"WITH {fx.BIP}, {fx.TRI} SELECT count(*) AS triangles FROM tri")
_add("lookup_intersection", lambda s, d: triangles.lookup_intersection(edges.degrees(fx.parts(s, d)).where("degree > 150").select("id"), fx.table(s, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("id")), ["id"]), f"WITH {fx.E}, {fx.DEG} SELECT id FROM deg WHERE degree > 150 AND id IN (SELECT p_partkey FROM part WHERE p_size > 25)")

# --- matrices -------------------------------------------------------------------------------------
_OUT = 'r AS "row", c AS "col", v AS val'


def _mat(name: str, f: Callable[[DataFrame], DataFrame], sql: str, source=fx.cust_part, cte: str = fx.M) -> None:
    _add(name, lambda s, d: f(source(s, d)), f"WITH {cte} {sql}")


_mat("mat_transpose", matrix.transpose, 'SELECT c AS "row", r AS "col", v AS val FROM m')
_mat("mat_extract_submatrix", lambda m: matrix.extract_submatrix(m, 20, 50), 'SELECT r - 20 AS "row", c AS "col", v AS val FROM m WHERE r BETWEEN 20 AND 69')
_add("mat_extract_rows", lambda s, d: matrix.extract_rows(fx.cust_part(s, d), s.range(40).select(F.col("id").alias("pos"), ((F.col("id") * 7) % 30).alias("row"))), f'WITH {fx.M}, p AS (SELECT i AS pos, (i * 7) % 30 AS r FROM (SELECT unnest(range(40)) AS i)) SELECT pos AS "row", c AS "col", v AS val FROM m JOIN p USING (r)')
_add("mat_extract_partition", lambda s, d: matrix.extract_partition(fx.cust_part(s, d), fx.table(s, d, "customer").select(F.col("c_custkey").alias("row"), F.col("c_nationkey").alias("part")), 3), f'WITH {fx.M}, p AS (SELECT c_custkey AS r, row_number() OVER (ORDER BY c_custkey) - 1 AS n FROM customer WHERE c_nationkey = 3) SELECT n AS "row", c AS "col", v AS val FROM m JOIN p USING (r)')
_mat("mat_split", lambda m: matrix.split(m, (F.col("row") + F.col("col")) % 3), f"SELECT (r + c) % 3 AS colour, {_OUT} FROM m")
_mat("mat_prune_rows", lambda m: matrix.prune(m, "row", 10, 40), f"SELECT {_OUT} FROM m WHERE r IN (SELECT r FROM m GROUP BY r HAVING count(*) BETWEEN 10 AND 40)")
_mat("mat_prune_cols", lambda m: matrix.prune(m, "col", 20, 30), f"SELECT {_OUT} FROM m WHERE c IN (SELECT c FROM m GROUP BY c HAVING count(*) BETWEEN 20 AND 30)")
for _what, _k, _o in (("row", "r", "c"), ("col", "c", "r")):
    for _norm, _x in ((1, "v"), (2, "v * v")):
        _mat(f"mat_lowfilter_{_what}_{_norm}", lambda m, w=_what, n=_norm: matrix.low_filter(m, w, n, 0.5), f"SELECT {_OUT} FROM (SELECT *, coalesce(sum({_x}) OVER (PARTITION BY {_k} ORDER BY v DESC, {_o} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum({_x}) OVER (PARTITION BY {_k}) AS t FROM m) WHERE b <= t * 0.5::DOUBLE")
    _mat(f"mat_topkplus_{_what}", lambda m, w=_what: matrix.top_k_plus(m, w, 3, 45.0), f"SELECT {_OUT} FROM (SELECT *, row_number() OVER (PARTITION BY {_k} ORDER BY v DESC, {_o}) AS n FROM m) WHERE n <= 3 OR v >= 45")
    _mat(f"mat_sums_{_what}", lambda m, w=_what: matrix.sums(m, w), f'SELECT {_k} AS "{_what}", sum(v) AS sum, count(*) AS nnz FROM m GROUP BY 1')
    _mat(f"mat_norms_{_what}", lambda m, w=_what: _r(matrix.norms(m, w), "norm", "sq_norm"), f'SELECT {_k} AS "{_what}", round(sqrt(sum(v * v)), 6) AS norm, round(sum(v * v), 6) AS sq_norm FROM m GROUP BY 1', fx.embedded, fx.EMB)
    for _n, _x in ((1, "sum(v)"), (2, "sqrt(sum(v * v))")):
        _mat(f"mat_normalise_{_what}_l{_n}", lambda m, w=_what, n=_n: matrix.normalise(m, w, n), f'SELECT r AS "row", c AS "col", v / x AS val FROM m JOIN (SELECT {_k}, {_x} AS x FROM m GROUP BY 1) USING ({_k})')
_mat("mat_zscore", lambda m: matrix.z_score_filter(m, 900.0), f"SELECT {_OUT} FROM m JOIN (SELECT r, count(*) AS n FROM m GROUP BY r) USING (r) WHERE v > 900::DOUBLE / n")
_mat("mat_compact", matrix.compact_columns, 'SELECT r AS "row", n AS "col", v AS val FROM m JOIN (SELECT c, row_number() OVER (ORDER BY count(*) DESC, c) - 1 AS n FROM m GROUP BY c) USING (c)')
_mat("mat_sorted_rows", lambda m: matrix.sorted_rows(m).select("key", F.transform("entries", lambda e: e["i"]).alias("cols"), F.transform("entries", lambda e: e["v"]).alias("vals")), "SELECT r AS key, list(c ORDER BY c) AS cols, list(v ORDER BY c) AS vals FROM m GROUP BY r")
_mat("mat_blockdiag", lambda m: matrix.block_diagonal(m, 3, 100_000, 100_000), 'SELECT r + k * 100000 AS "row", c + k * 100000 AS "col", v AS val FROM m, (SELECT unnest(range(3)) AS k)')
_BOTH_WAYS = "z AS (SELECT r, c, sum(a) AS a, sum(b) AS b FROM (SELECT r, c, v AS a, NULL AS b FROM m UNION ALL SELECT c, r, NULL, v FROM m) GROUP BY r, c)"
for _op, _x, _where in (
    ("sum", "coalesce(a, 0) + coalesce(b, 0)", ""),
    ("min", "least(a, b)", " WHERE a IS NOT NULL AND b IS NOT NULL"),
    ("max", "greatest(coalesce(a, b), coalesce(b, a))", ""),
    ("avg", "0.5::DOUBLE * (coalesce(a, 0) + coalesce(b, 0))", ""),
    ("avg_compat", "CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 0.25::DOUBLE * a + 0.5::DOUBLE * b ELSE 0.5::DOUBLE * coalesce(a, b) END", ""),
):
    _mat(f"mat_symmetrise_{_op}", lambda m, op=_op: matrix.make_symmetric(m, op.removesuffix("_compat"), op.endswith("_compat")), f'SELECT r AS "row", c AS "col", {_x} AS val FROM z{_where}', fx.in_line_order, f"{fx.LINE_ORDER}, {_BOTH_WAYS}")
for _kind, _x in {
    "maxtf": "0.5::DOUBLE + 0.5::DOUBLE * v / max(abs(v)) OVER (PARTITION BY r)",
    "maxtf2": "0.1::DOUBLE + 0.9::DOUBLE * v / max(abs(v)) OVER (PARTITION BY r)",
    "sqrt": "CASE WHEN v <> 0 THEN 0.1::DOUBLE + sign(v) * sqrt(abs(v)) ELSE v END",
    **{f"pow{p}": f"CASE WHEN v <> 0 THEN 0.1::DOUBLE + sign(v) * pow(abs(v), {p / 100}::DOUBLE) ELSE v END" for p in (25, 65, 75, 85)},
    "log": "CASE WHEN v <> 0 THEN 1 + sign(v) * log2(abs(v)) ELSE v END",
}.items():
    _mat(f"mat_scale_{_kind}", lambda m, k=_kind: _r(matrix.scale(m, k), "val"), f'SELECT r AS "row", c AS "col", round({_x}, 6) AS val FROM m', fx.embedded, fx.EMB)
_DF = "df AS (SELECT c, count(*) AS df FROM m GROUP BY c), a AS (SELECT count(DISTINCT r)::DOUBLE AS n, count(*)::DOUBLE AS nnz, count(DISTINCT c) AS k FROM m)"
_mat("mat_scale_idf", lambda m: _r(matrix.scale(m, "idf"), "val"), f'SELECT r AS "row", c AS "col", round(v * ln(n / df), 6) AS val FROM m JOIN df USING (c), a', fx.terms, f"{fx.TERMS}, {_DF}")
_mat("mat_scale_idf2", lambda m: _r(matrix.scale(m, "idf2"), "val"), f'SELECT r AS "row", c AS "col", round(v * ln((n + 2 * bg) / (bg + df)), 6) AS val FROM m JOIN df USING (c), (SELECT n, greatest(10, floor(0.5::DOUBLE * nnz / k)) AS bg FROM a)', fx.terms, f"{fx.TERMS}, {_DF}")


def _places(name: str, keys: str, salt: int) -> str:
    """CTE (k, t): a key and the key whose place it takes."""
    by = lambda order: f"row_number() OVER (ORDER BY {order}) AS n"
    return f"{name} AS (SELECT x.k, y.k AS t FROM (SELECT k, {by(f"md5('5:{salt}:' || k), k")} FROM ({keys})) x JOIN (SELECT k, {by('k')} FROM ({keys})) y USING (n))"


_ROW, _COL = _places("pr", "SELECT DISTINCT r AS k FROM m", 0), _places("pc", "SELECT DISTINCT c AS k FROM m", 1)
_mat("mat_shuffle_rows", lambda m: matrix.shuffle(m, "row", 5), f'SELECT pr.t AS "row", c AS "col", v AS val FROM m JOIN pr ON pr.k = r', cte=f"{fx.M}, {_ROW}")
_mat("mat_shuffle_cols", lambda m: matrix.shuffle(m, "col", 5), f'SELECT r AS "row", pc.t AS "col", v AS val FROM m JOIN pc ON pc.k = c', cte=f"{fx.M}, {_COL}")
_mat("mat_shuffle_both", lambda m: matrix.shuffle(m, "both", 5), f'SELECT pr.t AS "row", pc.t AS "col", v AS val FROM m JOIN pr ON pr.k = r JOIN pc ON pc.k = c', cte=f"{fx.M}, {_ROW}, {_COL}")
_mat("mat_shuffle_symmetric", lambda m: matrix.shuffle(m, "both", 5, symmetric=True), 'SELECT x.t AS "row", y.t AS "col", v AS val FROM m JOIN ps x ON x.k = r JOIN ps y ON y.k = c', fx.in_line_order, f"{fx.LINE_ORDER}, {_places('ps', 'SELECT r AS k FROM m UNION SELECT c FROM m', 0)}")
_mat("mat_reorder_symmetric", lambda m: edges.reorder(m, _by_entries(m), "row", "col"), 'SELECT x.n AS "row", y.n AS "col", v AS val FROM m JOIN p x ON x.k = r JOIN p y ON y.k = c', fx.in_line_order, f"{fx.LINE_ORDER}, p AS (SELECT k, row_number() OVER (ORDER BY count(*) DESC, k) - 1 AS n FROM (SELECT r AS k FROM m UNION ALL SELECT c FROM m) GROUP BY k)")


def _by_entries(m: DataFrame) -> DataFrame:
    """A permutation of a square matrix: indices by falling number of entries."""
    n = m.select(F.explode(F.array("row", "col")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    return edges.relabel_by_degree(n)


_add("tensor_unfold", lambda s, d: matrix.unfold(fx.tensor(s, d), 100_000), 'SELECT c_nationkey::BIGINT * 100000 + l_partkey AS "row", l_suppkey AS "col", sum(l_quantity) AS val, count(*) AS copies FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2')
_add("csrcnv_chain", lambda s, d: _r(matrix.compact_columns(matrix.normalise(matrix.low_filter(matrix.prune(matrix.prune(fx.cust_part(s, d), "col", 15, 60), "row", 5, 200), "row", 2, 0.7))), "val"), f'WITH {fx.M}, p AS (SELECT * FROM m WHERE c IN (SELECT c FROM m GROUP BY c HAVING count(*) BETWEEN 15 AND 60)), q AS (SELECT * FROM p WHERE r IN (SELECT r FROM p GROUP BY r HAVING count(*) BETWEEN 5 AND 200)), f AS (SELECT r, c, v FROM (SELECT *, coalesce(sum(v * v) OVER (PARTITION BY r ORDER BY v DESC, c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(v * v) OVER (PARTITION BY r) AS t FROM q) WHERE b <= t * 0.7::DOUBLE), n AS (SELECT r, c, v / sqrt(sum(v * v) OVER (PARTITION BY r)) AS v FROM f) SELECT r AS "row", k AS "col", round(v, 6) AS val FROM n JOIN (SELECT c, row_number() OVER (ORDER BY count(*) DESC, c) - 1 AS k FROM n GROUP BY c) USING (c)')

# --- similarity -----------------------------------------------------------------------------------
_SCORE = {"dotp": "dot", "cos": "dot / sqrt(qa * qb)", "jac": "dot / (qa + qb - dot)", "min": "low / (sa + sb - low)", "amin": "low / sa"}
_LEAST = {"dotp": 900.0, "cos": 0.2, "jac": 0.1, "min": 0.1, "amin": 0.15}
for _kind, _x in _SCORE.items():
    _add(f"knn_{_kind}", lambda s, d, k=_kind: _r(similarity.neighbours(fx.cust_part(s, d).where("row % 20 = 0"), fx.cust_part(s, d), k, 10, _LEAST[k]), "sim"), f'WITH {fx.M}, q AS (SELECT * FROM m WHERE r % 20 = 0), t AS (SELECT r, sum(v) AS s, sum(v * v) AS q FROM m GROUP BY r), p AS (SELECT q.r AS a, m.r AS b, sum(q.v * m.v) AS dot, sum(least(q.v, m.v)) AS low FROM q JOIN m USING (c) GROUP BY 1, 2), z AS (SELECT a, b, {_x} AS sim FROM (SELECT a, b, dot, low, x.s AS sa, x.q AS qa, y.s AS sb, y.q AS qb FROM p JOIN t x ON x.r = a JOIN t y ON y.r = b)) SELECT a AS query, b AS "row", round(sim, 6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS n FROM z WHERE sim >= {_LEAST[_kind]}::DOUBLE) WHERE n <= 10')
for _kind, _x in _SCORE.items():
    if _kind != "dotp":
        for _compat in (False, True):
            _cut = " JOIN (SELECT a, b, least(max(c) FILTER (WHERE hx), max(c) FILTER (WHERE hy)) AS z FROM f GROUP BY 1, 2) USING (a, b) WHERE c <= z" if _compat else ""
            _add(f"sim_pairs_{_kind}" + "_compat" * _compat, lambda s, d, k=_kind, t=_compat: _r(similarity.pair_similarity(fx.cust_part(s, d), fx.cust_part(s, d), fx.cust_part(s, d).where("row > 0").select(F.col("row").alias("i1"), (F.col("row") % 5).alias("i2")).distinct(), k, t), "sim"), f"WITH {fx.M}, p AS (SELECT DISTINCT r AS a, r % 5 AS b FROM m WHERE r > 0), x AS (SELECT a, b, c, v FROM p JOIN m ON a = r), y AS (SELECT a, b, c, v FROM p JOIN m ON b = r), f AS (SELECT a, b, c, coalesce(x.v, 0) AS x, coalesce(y.v, 0) AS y, x.v IS NOT NULL AS hx, y.v IS NOT NULL AS hy FROM x FULL JOIN y USING (a, b, c)), g AS (SELECT a, b, sum(x * y) AS dot, sum(least(x, y)) AS low, sum(x) AS sa, sum(y) AS sb, sum(x * x) AS qa, sum(y * y) AS qb FROM f{_cut} GROUP BY 1, 2) SELECT a AS i1, b AS i2, round(coalesce(CASE WHEN isfinite({_x}) THEN {_x} END, 0), 6) AS sim FROM g")


def _near_sql(side: str, row: str, col: str) -> str:
    """CTEs for ``side``: how alike the neighbours of a row are in m and in the part of m above 10."""
    unit = lambda where: f"SELECT {row} AS i, {col} AS j, v / sqrt(sum(v * v) OVER (PARTITION BY {row})) AS x FROM m{where}"
    score = lambda u: f"SELECT a.i AS q, b.i AS o, sum(a.x * b.x) AS s FROM {u} a JOIN {u} b USING (j) WHERE a.i IN (SELECT i FROM {side}_u) AND a.i IN (SELECT i FROM {side}_w) GROUP BY 1, 2"
    return f"""{side}_u AS ({unit('')}), {side}_w AS ({unit(' WHERE v > 10')}), {side}_p AS ({score(side + '_u')}), {side}_q AS ({score(side + '_w')}),
{side}_c AS (SELECT q, sum(p * r) / sqrt(sum(p * p) * sum(r * r)) AS c FROM (SELECT q, o, max(p) AS p, max(r) AS r FROM (SELECT q, o, s AS p, NULL AS r FROM {side}_p UNION ALL SELECT q, o, NULL, s FROM {side}_q) GROUP BY 1, 2) GROUP BY q)"""


def _neighbourhoods(s: SparkSession, d: str) -> DataFrame:
    m = stored(fx.cust_part(s, d), "bought")
    return _r(similarity.compare_neighbourhoods(m, m.where("val > 10")), "mean")


_add(
    "neighbourhood_similarity",
    _neighbourhoods,
    f"WITH {fx.M}, {_near_sql('r', 'r', 'c')}, {_near_sql('k', 'c', 'r')} SELECT 'rows' AS side, round(avg(c), 6) AS mean FROM r_c UNION ALL SELECT 'cols', round(avg(c), 6) FROM k_c",
)
_two = lambda s, d: (fx.cust_part(s, d), matrix.scale(fx.cust_part(s, d).where("val > 10"), "maxtf"))
_add(
    "sim_pairs_two_matrices",
    lambda s, d: _r(similarity.pair_similarity(*_two(s, d), fx.cust_part(s, d).select(F.col("row").alias("i1"), (F.col("row") + 1).alias("i2")).distinct(), "cos"), "sim"),
    f"WITH {fx.M}, n AS (SELECT r, c, 0.5::DOUBLE + 0.5::DOUBLE * v / max(v) OVER (PARTITION BY r) AS v FROM m WHERE v > 10), p AS (SELECT DISTINCT r AS i1, r + 1 AS i2 FROM m), "
    "x AS (SELECT i1, i2, c, v AS a, 0 AS b FROM p JOIN m ON r = i1 UNION ALL SELECT i1, i2, c, 0, v FROM p JOIN n ON r = i2), y AS (SELECT i1, i2, c, sum(a) AS a, sum(b) AS b FROM x GROUP BY 1, 2, 3) "
    "SELECT i1, i2, round(coalesce(sum(a * b) / nullif(sqrt(sum(a * a) * sum(b * b)), 0), 0), 6) AS sim FROM y GROUP BY 1, 2",
)

# --- iterative graph algorithms: on the whole co-purchase graph, and where its one component shows little
# also on the graph of parts that are together in several orders
_CC = "cc(id, component) USING KEY (id) AS (SELECT src, min(least(src, dst)) FROM b GROUP BY src UNION SELECT b.dst, min(cc.component) FROM cc JOIN b ON b.src = cc.id JOIN recurring.cc o ON o.id = b.dst WHERE cc.component < o.component GROUP BY b.dst)"


def _spread_sql(starts: str, b: str = "b") -> str:
    return f"bfs(id, level) USING KEY (id) AS ({starts} UNION SELECT DISTINCT {b}.dst, bfs.level + 1 FROM bfs JOIN {b} ON {b}.src = bfs.id WHERE NOT EXISTS (SELECT 1 FROM recurring.bfs o WHERE o.id = {b}.dst))"


def _from(g: DataFrame, f: Callable[[DataFrame, int], DataFrame], what, two_ways: bool = True) -> DataFrame:
    """``f`` of a graph, made once, and of one of its ids."""
    g = stored(g, "graph")
    return f(edges.both_directions(g) if two_ways else g, int(g.agg(what).first()[0]))


def _by_degree(g: DataFrame, least: int) -> DataFrame:
    """The order of a graph that is made once."""
    return graph.bfs_order_by_degree(edges.both_directions(g), stored(edges.degrees(g), "degrees"), least)


for _name, _graph, _e in (("", fx.parts, fx.E), ("_strong", fx.strong, fx.STRONG)):
    _add(f"components{_name}", lambda s, d, g=_graph: components.connected_components(g(s, d), "u", "v"), f"WITH RECURSIVE {_e}, {fx.BOTH}, {_CC} SELECT id, component FROM cc")
    _add(f"bfs_levels{_name}", lambda s, d, g=_graph: _from(g(s, d), graph.bfs_levels, F.min("u")), f"WITH RECURSIVE {_e}, {fx.BOTH}, {_spread_sql('SELECT min(src), 0 FROM b')} SELECT id, level FROM bfs")
    _add(
        f"bfs_order{_name}",
        lambda s, d, g=_graph: _from(g(s, d), graph.bfs_order, F.max("v")),
        f"WITH RECURSIVE {_e}, {fx.BOTH}, {_CC}, h AS (SELECT max(src) AS s FROM b), home AS (SELECT component AS hc FROM cc, h WHERE id = s), "
        f"{_spread_sql('SELECT s, 0 FROM h UNION ALL SELECT id, 0 FROM cc, home WHERE id = component AND component <> hc')} "
        "SELECT id, component, level, row_number() OVER (ORDER BY component <> hc, component, level, id) - 1 AS place FROM bfs JOIN cc USING (id), home",
    )
    _least = 110 if _graph is fx.parts else 8
    _add(
        f"bfs_order_by_degree{_name}",
        lambda s, d, g=_graph, n=_least: _by_degree(stored(g(s, d), "graph"), n),
        f"WITH RECURSIVE {_e}, {fx.DEG}, low AS (SELECT id FROM deg WHERE degree < {_least}), l AS (SELECT u, v FROM e WHERE u IN (SELECT id FROM low) AND v IN (SELECT id FROM low)), "
        f"b AS (SELECT u AS src, v AS dst FROM l UNION ALL SELECT v, u FROM l UNION ALL SELECT id, id FROM low), {_CC}, {_spread_sql('SELECT id, 0 FROM cc WHERE id = component')} "
        f"SELECT id, row_number() OVER (ORDER BY g, k, component, level, id) - 1 AS place FROM (SELECT id, 0 AS g, -degree AS k, 0 AS component, 0 AS level FROM deg WHERE degree >= {_least} UNION ALL SELECT id, 1, 0, component, level FROM bfs JOIN cc USING (id))",
    )
    _add(
        f"bfs_search_report{_name}",
        lambda s, d, g=_graph: _from(g(s, d), lambda e, v: graph.search_report(e, v)[1], F.min("u")),
        f"WITH RECURSIVE {_e}, {fx.BOTH}, {_spread_sql('SELECT min(src), 0 FROM b')}, n AS (SELECT level, count(*) AS vertices FROM bfs GROUP BY 1), "
        "ends AS (SELECT x.level AS lx, y.level AS ly FROM b LEFT JOIN bfs x ON x.id = b.src LEFT JOIN bfs y ON y.id = b.dst), "
        "f AS (SELECT level, vertices, (SELECT count(*) FROM ends WHERE lx = level) AS edges_out, (SELECT count(*) FROM ends WHERE ly IS NULL OR ly > level) AS edges_rest FROM n), "
        "w AS (SELECT *, CASE WHEN edges_out = 0 OR edges_rest = 0 THEN 'none' WHEN edges_out > edges_rest THEN 'bottom-up' ELSE 'top-down' END AS way FROM f), "
        "p AS (SELECT *, lag(way) OVER (ORDER BY level) AS before FROM w), "
        "k AS (SELECT *, coalesce(max(level) FILTER (WHERE before = 'bottom-up') OVER (ORDER BY level), -1) AS kept FROM p) "
        "SELECT level, vertices, edges_out, edges_rest, way, CASE way WHEN 'none' THEN 0 WHEN 'bottom-up' THEN edges_rest ELSE (SELECT count(*) FROM ends WHERE lx = level AND ly > kept) END AS edges_read FROM k",
    )
for _kind in range(1, 7):
    _add(f"best_first_order_{_kind}", lambda s, d, k=_kind: _from(fx.strong(s, d), lambda e, v: graph.best_first_order(e, v, k), F.min("u")))
_add("best_first_order_3_matrix", lambda s, d: _from(fx.strong(s, d), lambda e, v: graph.best_first_order(e, v, 3, matrix=True), F.min("u")))
_PATHS = "sp(id, dist) USING KEY (id) AS (SELECT min(src), 0::DOUBLE FROM wt WHERE src < dst UNION SELECT wt.dst, min(sp.dist + wt.w) FROM sp JOIN wt ON wt.src = sp.id LEFT JOIN recurring.sp o ON o.id = wt.dst WHERE o.id IS NULL OR sp.dist + wt.w < o.dist GROUP BY wt.dst) SELECT v.id, coalesce(dist, -1) AS dist FROM (SELECT DISTINCT src AS id FROM wt) v LEFT JOIN sp ON sp.id = v.id"
_add("sssp", lambda s, d: _from(fx.weighted(s, d), graph.shortest_paths, F.min("src"), False), f"WITH RECURSIVE {fx.WEIGHTED}, {_PATHS}")
_add("sssp_delta", lambda s, d: _from(fx.weighted(s, d), lambda e, v: graph.delta_stepping(e, v)[0], F.min("src"), False), f"WITH RECURSIVE {fx.WEIGHTED}, {_PATHS}")
_add("sssp_delta_priced", lambda s, d: _from(fx.priced(s, d), lambda e, v: graph.delta_stepping(e, v)[0], F.min("src"), False), f"WITH RECURSIVE {fx.PRICED}, {_PATHS}")


def _pr_sql(restart: str, more: str = "SELECT id, round(pr, 6) AS pr FROM k WHERE i = 10", wt: str = fx.WEIGHTED) -> str:
    return f"WITH RECURSIVE {wt}, n AS (SELECT DISTINCT src AS id FROM wt), r AS ({restart}), p AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM wt), k(i, id, pr) AS (SELECT 0, id, r FROM r UNION ALL SELECT i, id, pr FROM (SELECT k.i + 1 AS i, p.dst AS id, 0.85::DOUBLE * sum(k.pr * p.p) + 0.15::DOUBLE * any_value(r.r) AS pr FROM k JOIN p ON p.src = k.id JOIN r ON r.id = p.dst WHERE k.i < 10 GROUP BY k.i, p.dst)) {more}"


def _ranks(g: DataFrame, restart: DataFrame | None = None) -> DataFrame:
    return graph.pagerank(g, max_iter=10, fixed=True, restart=restart)[0]


def _one(g: DataFrame, v: int) -> DataFrame:
    return _ranks(g, g.sparkSession.range(1).select(F.lit(v).cast("long").alias("id"), F.lit(1.0).alias("r")))


def _drawn(s: SparkSession, d: str) -> DataFrame:
    g = stored(fx.weighted(s, d), "graph")
    return _ranks(g, graph.random_restarts(g.select(F.col("src").alias("id")).distinct(), 2, 7)[1])


def _report(s: SparkSession, d: str) -> DataFrame:
    g = stored(fx.weighted(s, d), "graph")
    return graph.pagerank_report(g, _ranks(g))


_UNIFORM = "SELECT id, 1::DOUBLE / (SELECT count(*) FROM n) AS r FROM n"
_add("pagerank", lambda s, d: _r(_ranks(fx.weighted(s, d)), "pr"), _pr_sql(_UNIFORM))
_add("pagerank_personalised", lambda s, d: _r(_from(fx.weighted(s, d), _one, F.min("src"), False), "pr"), _pr_sql("SELECT id, (id = (SELECT min(src) FROM wt))::INT::DOUBLE AS r FROM n"))
_add(
    "pagerank_random_restart",
    lambda s, d: _r(_drawn(s, d), "pr"),
    _pr_sql("SELECT id, x / sum(x) OVER () AS r FROM (SELECT id, ('0x' || substr(md5('8:' || id), 1, 8))::BIGINT + 1::DOUBLE AS x FROM n)"),
)


def _packed(s: SparkSession, d: str, f: Callable[[packed.PackedGraph], DataFrame]) -> DataFrame:
    return f(packed.pack_graph(fx.parts_both(s, d)))


_add("packed_edges", lambda s, d: _packed(s, d, packed.unpack), f"WITH {fx.E}, {fx.BOTH} SELECT src, dst FROM b")
_add("packed_degrees", lambda s, d: _packed(s, d, packed.out_degrees), f"WITH {fx.E}, {fx.BOTH} SELECT src AS id, count(*) AS degree FROM b GROUP BY 1")
_add("packed_pagerank", lambda s, d: _r(_packed(s, d, lambda g: packed.pagerank(g, rounds=10)), "pr"), _pr_sql(_UNIFORM, wt=f"{fx.E}, {fx.BOTH}, wt AS (SELECT src, dst, 1::DOUBLE AS w FROM b)"))


def _perm(s: SparkSession, d: str) -> DataFrame:
    return edges.relabel_by_degree(edges.degrees(fx.parts(s, d))).toDF("id", "place")


_PERM = f"{fx.E}, {fx.DEG}, {fx.BOTH}, p AS (SELECT id, row_number() OVER (ORDER BY degree DESC, id) - 1 AS place FROM deg)"
_add("bandwidth_compactness", lambda s, d: _r(graph.compactness(fx.parts_both(s, d), _perm(s, d)), "mean"), f"WITH {_PERM}, z AS (SELECT abs(x.place - y.place) AS d FROM b JOIN p x ON x.id = src JOIN p y ON y.id = dst) SELECT round(avg(d), 6) AS mean, count(*) FILTER (WHERE d = 1) AS near1, count(*) FILTER (WHERE d = 2) AS near2, count(*) FILTER (WHERE d = 3) AS near3 FROM z")
_add("centroid_reorder", lambda s, d: graph.centroid_reorder(fx.parts_both(s, d), _perm(s, d)), f"WITH {_PERM}, z AS (SELECT src AS id, avg(y.place) AS m FROM b JOIN p y ON y.id = dst GROUP BY src) SELECT id, row_number() OVER (ORDER BY place + 0.5::DOUBLE * (m - place), id) - 1 AS place FROM p JOIN z USING (id)")
_add(
    "pagerank_report",
    lambda s, d: _report(s, d).select("id", F.round("pr", 6).alias("pr"), "degree", F.round("max_diff", 6).alias("max_diff")),
    _pr_sql(_UNIFORM, "SELECT a.id, round(a.pr, 6) AS pr, count(*) AS degree, round(max(abs(a.pr - o.pr)), 6) AS max_diff FROM k a JOIN wt ON wt.src = a.id JOIN k o ON o.id = wt.dst WHERE a.i = 10 AND o.i = 10 GROUP BY a.id, a.pr"),
)

# --- itemsets and ranked lists --------------------------------------------------------------------
_add("frequent_itemsets", lambda s, d: mining.frequent_itemsets(fx.baskets(s, d), 5, max_len=3), f"WITH {fx.TX}, f AS (SELECT * FROM tx WHERE item IN (SELECT item FROM tx GROUP BY item HAVING count(*) >= 5)) SELECT [item] AS items, count(*) AS support FROM f GROUP BY item UNION ALL SELECT [a.item, b.item], count(*) FROM f a JOIN f b ON a.tid = b.tid AND a.item < b.item GROUP BY a.item, b.item HAVING count(*) >= 5 UNION ALL SELECT [a.item, b.item, c.item], count(*) FROM f a JOIN f b ON a.tid = b.tid AND a.item < b.item JOIN f c ON c.tid = b.tid AND b.item < c.item GROUP BY a.item, b.item, c.item HAVING count(*) >= 5")
_add("frequent_itemsets_maxfreq", lambda s, d: mining.frequent_itemsets(fx.baskets(s, d), 4, 600, 2, 2, True), f"WITH {fx.TX}, f AS (SELECT * FROM tx WHERE item IN (SELECT item FROM tx GROUP BY item HAVING count(*) BETWEEN 4 AND 600)) SELECT [a.item, b.item] AS items, count(*) AS support, list(a.tid ORDER BY a.tid) AS tids FROM f a JOIN f b ON a.tid = b.tid AND a.item < b.item GROUP BY a.item, b.item HAVING count(*) >= 4")


def _all_sets(tx: str, least: int, kept: str = "true") -> str:
    """SQL of the itemsets of any length as occurrences f(items, tid), longer and longer."""
    return (
        f"WITH RECURSIVE {tx}, ok AS (SELECT item FROM tx GROUP BY item HAVING count(*) >= {least} AND {kept}), t AS (SELECT tid, item FROM tx WHERE item IN (SELECT item FROM ok)), "
        f"f(items, tid) AS (SELECT [item], tid FROM t UNION ALL SELECT items, tid FROM (SELECT list_append(items, item) AS items, tid, count(*) OVER (PARTITION BY list_append(items, item)) AS n "
        f"FROM f JOIN t USING (tid) WHERE item > items[-1]) WHERE n >= {least}) "
    )


_add("itemsets_projected", lambda s, d: mining.projected_itemsets(fx.nations(s, d), 12), _all_sets(fx.NATIONS, 12) + "SELECT items, count(*) AS support FROM f GROUP BY items")
_add("itemsets_projected_tids", lambda s, d: mining.projected_itemsets(fx.baskets(s, d), 4, 600, 2, -1, True), _all_sets(fx.TX, 4, "count(*) <= 600") + "SELECT items, count(*) AS support, list(tid ORDER BY tid) AS tids FROM f WHERE len(items) > 1 GROUP BY items")
_add("rank_accuracy", lambda s, d: _r(metrics.accuracy(fx.ranked(s, d)), "accuracy"), f"WITH {fx.RANKED}, z AS (SELECT sum(CASE WHEN label > 0 THEN 1 ELSE -1 END) OVER (ORDER BY score DESC, key) AS g FROM r) SELECT round(100::DOUBLE * (max(g) + (SELECT count(*) FROM r WHERE label <= 0)) / (SELECT count(*) FROM r), 6) AS accuracy FROM z")
for _n, _compat in ((None, False), (50, False), (50, True)):
    _half = "sum((fp * (2 * t - tp)) // 2)" if _compat else "sum(fp * (2 * t - tp) / 2::DOUBLE)"
    _add("rank_roc" + (f"_{_n}" if _n else "") + "_compat" * _compat, lambda s, d, n=_n, c=_compat: _r(metrics.roc_n(fx.ranked(s, d), n, c), "roc"), f"WITH {fx.RANKED}, g AS (SELECT score, count(*) FILTER (WHERE label > 0) AS tp, count(*) FILTER (WHERE label <= 0) AS fp FROM r GROUP BY score), z AS (SELECT *, sum(tp) OVER (ORDER BY score DESC) AS t, sum(fp) OVER (ORDER BY score DESC) AS f FROM g) SELECT round({_half}::DOUBLE / ((SELECT count(*) FROM r WHERE label > 0) * max(f)), 6) AS roc FROM z" + (f" WHERE f - fp < {_n}" if _n else ""))
_add("rank_median_rfp", lambda s, d: _r(metrics.median_rfp(fx.ranked(s, d)), "rfp"), f"WITH {fx.RANKED}, z AS (SELECT sum((label > 0)::INT) OVER w AS t, sum((label <= 0)::INT) OVER w AS f FROM r WINDOW w AS (ORDER BY score DESC, key)) SELECT round(min(f)::DOUBLE / (SELECT count(*) FROM r WHERE label <= 0), 6) AS rfp FROM z WHERE t >= (SELECT (count(*) + 1) // 2 FROM r WHERE label > 0)")
_add("mean_std", lambda s, d: _r(metrics.mean_std(fx.table(s, d, "orders"), "o_totalprice"), "mean", "std"), "SELECT round(avg(o_totalprice), 6) AS mean, round(stddev_pop(o_totalprice), 6) AS std FROM orders")

# --- vectors, sets, scalars -----------------------------------------------------------------------


def _vector(s: SparkSession, d: str) -> DataFrame:
    return fx.table(s, d, "part").select(F.col("p_partkey").alias("i"), F.col("p_size").cast("double").alias("x"))


_V = "v AS (SELECT p_partkey AS i, p_size::DOUBLE AS x FROM part)"
_add("blas_reductions", lambda s, d: _r(blas.reductions(_vector(s, d)), "norm2"), f"WITH {_V} SELECT max(x) AS max, min(x) AS min, (SELECT i FROM v ORDER BY x DESC, i LIMIT 1) AS argmax, (SELECT i FROM v ORDER BY x, i LIMIT 1) AS argmin, sum(x) AS sum, round(sqrt(sum(x * x)), 6) AS norm2 FROM v")
_add("blas_argmax_n", lambda s, d: blas.argmax_n(_vector(s, d), 7), f"WITH {_V} SELECT i FROM v ORDER BY x DESC, i LIMIT 1 OFFSET 6")
_add("blas_dot", lambda s, d: blas.dot(_vector(s, d), _vector(s, d).withColumn("x", F.col("x") + 1)), f"WITH {_V} SELECT sum(x * (x + 1)) AS dot FROM v")
_add("blas_arrays", lambda s, d: fx.table(s, d, "embeddings").select("vec_id", F.round(blas.array_norm2("embedding"), 4).alias("norm"), F.round(F.get(blas.axpy(2.0, "embedding", blas.scaled("embedding", 3.0)), 0), 4).alias("axpy0")), "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 4) AS norm, round(5 * embedding[1]::DOUBLE, 4) AS axpy0 FROM embeddings")
_add("top_k_largest", lambda s, d: blas.top_k(fx.table(s, d, "orders").select("o_orderkey", "o_totalprice"), 25, "o_totalprice", tie="o_orderkey"), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
_add("top_k_smallest_per_group", lambda s, d: blas.top_k(fx.table(s, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), 2, "o_totalprice", False, ["o_custkey"], "o_orderkey"), "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS n FROM orders) WHERE n <= 2")
_add("sort_keys", lambda s, d: ordering.with_rank(fx.table(s, d, "customer").select("c_name", "c_custkey"), F.col("c_name").desc(), "c_custkey", name="place"), "SELECT c_name, c_custkey, row_number() OVER (ORDER BY c_name DESC, c_custkey) - 1 AS place FROM customer")

_add(
    "sorted_search",
    lambda s, d: edges.adjacency(fx.parts(s, d)).select("id", blas.lower_bound("nbrs", F.col("id") + 7).alias("low"), blas.upper_bound("nbrs", F.col("id") + 7).alias("high"), blas.place_of("nbrs", F.col("id") + 7).alias("at")),
    f"WITH {fx.E}, {fx.BOTH}, a AS (SELECT src AS id, list(dst ORDER BY dst) AS l FROM b GROUP BY src) SELECT id, len(list_filter(l, lambda x: x < id + 7))::INT AS low, len(list_filter(l, lambda x: x <= id + 7))::INT AS high, (coalesce(list_position(l, id + 7), 0) - 1)::INT AS at FROM a",
)
_add("incset", lambda s, d: fx.table(s, d, "part").select("p_partkey", blas.incset(F.col("p_size") - 2, 5).alias("x")), "SELECT p_partkey, range(5, 5 + greatest(p_size - 2, 0))::INT[] AS x FROM part")


def _sets(s: SparkSession, d: str) -> DataFrame:
    line = fx.table(s, d, "lineitem").select((F.col("l_suppkey") % 128).alias("m"), (F.col("l_partkey") % 50).alias("k"), "l_returnflag")
    a = bitmaps.from_members(line.where("l_returnflag = 'A'"), "k", "m", 128).withColumnRenamed("bits", "a")
    b = bitmaps.from_members(line.where("l_returnflag = 'R'"), "k", "m", 128).withColumnRenamed("bits", "b")
    n = lambda f: bitmaps.count(f("a", "b")).cast("long")
    return a.join(b, "k").select("k", n(bitmaps.and_).alias("n_and"), n(bitmaps.or_).alias("n_or"), n(bitmaps.xor).alias("n_xor"), n(bitmaps.and_not).alias("n_and_not"), bitmaps.count(bitmaps.not_("a", 100)).cast("long").alias("n_not"))


_add("bitset_operations", _sets, "WITH s AS (SELECT DISTINCT l_partkey % 50 AS k, l_suppkey % 128 AS m, l_returnflag AS f FROM lineitem), z AS (SELECT k, m, bool_or(f = 'A') AS a, bool_or(f = 'R') AS b FROM s GROUP BY 1, 2) SELECT k, count(*) FILTER (WHERE a AND b) AS n_and, count(*) FILTER (WHERE a OR b) AS n_or, count(*) FILTER (WHERE a <> b) AS n_xor, count(*) FILTER (WHERE a AND NOT b) AS n_and_not, 128 - count(*) FILTER (WHERE a) - (28 - 0) + count(*) FILTER (WHERE a AND m >= 100) AS n_not FROM z GROUP BY k HAVING bool_or(a) AND bool_or(b)")
_P = "p_partkey"
_add("str_translate", lambda s, d: fx.table(s, d, "part").select(_P, scalars.chars_replace("p_name", "aeiou", "AE").alias("x")), "SELECT p_partkey, translate(p_name, 'aeiou', 'AE') AS x FROM part")
_add("str_regex_replace", lambda s, d: fx.table(s, d, "part").select(_P, scalars.regex_replace("p_type", "([a-z]+)n", "<$1>", "gi").alias("every"), scalars.regex_replace("p_type", "([A-Z])[A-Z]", "$1_$0", "").alias("first"), scalars.regex_matches("p_type", "[AEIOU]", "g").cast("long").alias("n")), r"SELECT p_partkey, regexp_replace(p_type, '(?i)([a-z]+)n', '<\1>', 'g') AS every, regexp_replace(p_type, '([A-Z])[A-Z]', '\1_\0') AS first, len(regexp_extract_all(p_type, '[AEIOU]')) AS n FROM part")
_add("str_trim", lambda s, d: fx.table(s, d, "part").select(_P, scalars.trim_end("p_brand", "0123456789").alias("tail"), scalars.trim_start("p_brand", "Brand").alias("head")), "SELECT p_partkey, rtrim(p_brand, '0123456789') AS tail, ltrim(p_brand, 'Brand') AS head FROM part")
_add("str_case", lambda s, d: fx.table(s, d, "part").select(_P, scalars.upper("p_name").alias("up"), scalars.lower("p_type").alias("low"), scalars.equal_any_case("p_name", F.upper("p_name")).alias("same")), "SELECT p_partkey, upper(p_name) AS up, lower(p_type) AS low, 1 AS same FROM part")
_add("str_tokenise", lambda s, d: fx.table(s, d, "part").select(_P, scalars.tokenize("p_type", " ").alias("tokens")), "SELECT p_partkey, list_filter(string_split(p_type, ' '), lambda x: x <> '') AS tokens FROM part")
_add("str_reverse_compare", lambda s, d: fx.table(s, d, "part").select(_P, scalars.compare_reversed("p_name", "p_type").alias("c")), "SELECT p_partkey, CASE WHEN reverse(p_name) < reverse(p_type) THEN -1 WHEN reverse(p_name) > reverse(p_type) THEN 1 ELSE 0 END AS c FROM part")
_add("str_symbol_id", lambda s, d: fx.table(s, d, "customer").select("c_custkey", scalars.string_id({"building": 1, "Machinery": 2}, "c_mktsegment").alias("id")), "SELECT c_custkey, CASE lower(c_mktsegment) WHEN 'building' THEN 1 WHEN 'machinery' THEN 2 ELSE -1 END AS id FROM customer")
_add("str_symbol_codes", lambda s, d: fx.table(s, d, "customer").select("c_custkey", scalars.symbol_codes("c_mktsegment", "ABCDEFGHIJKLM").alias("codes")), "SELECT c_custkey, list_transform(string_split(c_mktsegment, ''), lambda x: (instr('ABCDEFGHIJKLM', x) - 1)::INT) AS codes FROM customer")
_add("date_format_parse", lambda s, d: fx.table(s, d, "orders").select("o_orderkey", scalars.time_to_string("o_orderdate").alias("text"), scalars.string_to_time(scalars.time_to_string("o_orderdate")).alias("secs"), scalars.string_to_time("o_orderstatus").alias("bad")), "SELECT o_orderkey, strftime(o_orderdate, '%m/%d/%Y %H:%M:%S') AS text, epoch(date_trunc('second', o_orderdate))::BIGINT AS secs, -1::BIGINT AS bad FROM orders")
_add("math_log2", lambda s, d: fx.table(s, d, "part").select(_P, scalars.floor_log2("p_partkey").alias("fl"), scalars.is_power_of_two("p_partkey").alias("p2"), F.round(scalars.log2(F.col("p_partkey") + 1), 6).alias("lg"), scalars.sign_of(F.col("p_size") - 25, F.col("p_size")).alias("sg"), scalars.max3("p_size", F.lit(10), F.lit(20)).alias("m3")), "SELECT p_partkey, CASE WHEN p_partkey <= 1 THEN 0 ELSE floor(log2(p_partkey))::INT END AS fl, p_partkey > 0 AND bit_count(p_partkey) = 1 AS p2, round(log2(p_partkey + 1), 6) AS lg, CASE WHEN p_size >= 25 THEN p_size ELSE -p_size END AS sg, greatest(p_size, 10, 20) AS m3 FROM part")
_add("format_commas", lambda s, d: fx.table(s, d, "orders").select("o_orderkey", scalars.with_commas(F.col("o_orderkey") * 1001).alias("x")), "SELECT o_orderkey, format('{:,}', o_orderkey * 1001) AS x FROM orders")
_add("base64_roundtrip", lambda s, d: fx.table(s, d, "part").select(_P, F.rpad("p_brand", 12, "x").alias("b")).select(_P, scalars.base64_encode(F.col("b").cast("binary")).alias("coded"), scalars.base64_decode(scalars.base64_encode(F.col("b").cast("binary"))).cast("string").alias("back")), "SELECT p_partkey, base64(encode(rpad(p_brand, 12, 'x'))) AS coded, rpad(p_brand, 12, 'x') AS back FROM part")
_add("random_permutation", lambda s, d: ordering.with_rank(fx.table(s, d, "customer").select("c_custkey"), F.md5(F.concat(F.lit("3:"), F.col("c_custkey").cast("string"))), "c_custkey", name="place"), "SELECT c_custkey, row_number() OVER (ORDER BY md5('3:' || c_custkey), c_custkey) - 1 AS place FROM customer")
_add("random_in_range", lambda s, d: fx.table(s, d, "customer").select("c_custkey", scalars.random_in_range(100, 5, "c_custkey").alias("x")), "SELECT c_custkey, ('0x' || substr(md5('5:' || c_custkey), 1, 12))::BIGINT % 100 AS x FROM customer")


# --- results as lines, of queries above
_add("lines_triangles", lambda s, d: results.triangle_line(_QUERIES["triangle_count"](s, d)), f"SELECT 'There are ' || triangles || ' triangles in the input graph.' AS value FROM ({_SQL['triangle_count']})")
_add("lines_itemsets", lambda s, d: results.itemset_lines(_QUERIES["frequent_itemsets"](s, d)), f"SELECT support || ' ' || array_to_string(items, ' ') AS value FROM ({_SQL['frequent_itemsets']})")
_add("lines_neighbours", lambda s, d: results.neighbour_lines(_QUERIES["knn_jac"](s, d)), f"SELECT printf('%8d %8d %.3f', query, \"row\", sim + 1e-12) AS value FROM ({_SQL['knn_jac']})")
_add("lines_ranks", lambda s, d: results.rank_lines(_ranks(fx.weighted(s, d))), _pr_sql(_UNIFORM, "SELECT id, printf('%d %.4e', id, pr) AS value FROM k WHERE i = 10"))

for _name, _f in source_queries.QUERIES.items():
    _add(_name, _f, source_queries.SQL[_name])


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
