"""Queries of sources and sinks: a table is written in a format and read back; the SQL is the table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import edges
from weftgraph.plans import fixtures as fx
from weftgraph.sources import matrix_files, records, text_files
from weftgraph.storage import new_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _file(spark: SparkSession, name: str) -> str:
    """A path in a fresh shared folder."""
    folder = new_path(spark, "source")
    text_files.make_path(spark, folder)
    return f"{folder}/{name}"


def _query(name: str, sql: str):
    def put(f: Query) -> Query:
        QUERIES[name], SQL[name] = f, sql
        return f

    return put


# --- packed records


@_query("src_packed_edges", f"WITH {fx.RAW} SELECT src, dst FROM raw")
def _packed_edges(s: SparkSession, d: str) -> DataFrame:
    path = _file(s, "edges.bin")
    records.write_edges(fx.raw(s, d), path)
    return records.read_edges(s, path)


def _clean_file(s: SparkSession, d: str) -> str:
    path = _file(s, "undirected.bin")
    records.write_clean_edges(fx.parts(s, d), path)
    return path


@_query("src_clean_edges", f"WITH {fx.E} SELECT u, v FROM e")
def _clean_edges(s: SparkSession, d: str) -> DataFrame:
    return records.read_clean_edges(s, _clean_file(s, d))


@_query("src_clean_edges_both_directions", f"WITH {fx.E}, {fx.BOTH} SELECT src, dst FROM b")
def _clean_both(s: SparkSession, d: str) -> DataFrame:
    return edges.both_directions(records.read_clean_edges(s, _clean_file(s, d)))


@_query("src_counted_tuples", "SELECT l_orderkey AS f0, l_partkey AS f1, l_linenumber AS f2, l_quantity AS f3 FROM lineitem")
def _counted_tuples(s: SparkSession, d: str) -> DataFrame:
    path, names = _file(s, "tuples.bin"), ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity"]
    records.write_counted(fx.table(s, d, "lineitem"), path, names, "i8,i8,i4,f8", names)
    return records.read_counted(s, path, "i8,i8,i4,f8").drop("idx")


@_query("src_counted_vector", "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS idx, o_totalprice AS f0 FROM orders")
def _counted_vector(s: SparkSession, d: str) -> DataFrame:
    path = _file(s, "vector.bin")
    records.write_counted(fx.table(s, d, "orders"), path, ["o_totalprice"], "f8", ["o_orderkey"])
    return records.read_counted(s, path, "f8")


def _array(kind: str, sql_kind: str) -> None:
    value = "p_size * 3 - 40" if kind[0] == "i" else "p_size + 0.5"

    @_query(f"src_array_{kind}", f"SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS idx, ({value})::{sql_kind} AS value FROM part")
    def run(s: SparkSession, d: str) -> DataFrame:
        path = _file(s, f"array.{kind}")
        records.write_array(fx.table(s, d, "part").select(F.col("p_partkey").alias("idx"), F.expr(value).alias("value")), path, kind)
        return records.read_array(s, path, kind)


for _kind, _sql in (("i4", "INT"), ("i8", "BIGINT"), ("f4", "FLOAT"), ("f8", "DOUBLE")):
    _array(_kind, _sql)

# --- matrices
_ALL = 'SELECT r AS "row", c AS "col", v AS val FROM m'
_ONES = 'SELECT r AS "row", c AS "col", 1::DOUBLE AS val FROM m'


def _matrix(name: str, fmt: str, sql: str, values: bool | None = True) -> None:
    @_query(f"src_{name}", f"WITH {fx.M} {sql}")
    def run(s: SparkSession, d: str) -> DataFrame:
        path = _file(s, f"matrix.{fmt}")
        shape = [fx.table(s, d, t).count() for t in ("customer", "part")]
        matrix_files.write_matrix(fx.cust_part(s, d), path, "auto", *shape, values=bool(values))
        return matrix_files.read_matrix(s, path, "auto", values)


for _fmt in ("csr", "cluto", "ijv", "bijv", "binrow", "bincol"):
    _matrix(f"matrix_{_fmt}", _fmt, _ALL)
    if _fmt != "cluto":
        _matrix(f"matrix_{_fmt}_ones", _fmt, _ONES, False)
_matrix("matrix_csr_pattern", "csr", 'SELECT r AS "row", c AS "col" FROM m', None)


@_query("src_graph_lines", f'WITH {fx.E} SELECT u AS "row", v AS "col", 1::DOUBLE AS val FROM e')
def _graph_lines(s: SparkSession, d: str) -> DataFrame:
    path = _file(s, "graph.tsv")
    fx.parts(s, d).select(F.concat_ws("\t", F.col("u") + 1, F.col("v") + 1).alias("value")).write.text(path)
    return matrix_files.read_ijv(s, path, values=False, one_based=True)


@_query("src_graph_metis", f'WITH {fx.WEIGHTED} SELECT src AS "row", dst AS "col", w AS val FROM wt')
def _graph_metis(s: SparkSession, d: str) -> DataFrame:
    path, n = _file(s, "graph.metis"), fx.table(s, d, "part").count()
    matrix_files.write_matrix(fx.weighted(s, d).toDF("row", "col", "val"), path, "auto", n, n)
    return matrix_files.read_metis(s, path)[0]


@_query("src_metis_vertices", "SELECT p_partkey AS id, p_size::DOUBLE AS size, [p_partkey, p_size + 1]::DOUBLE[] AS weights FROM part")
def _metis_vertices(s: SparkSession, d: str) -> DataFrame:
    """Vertices with a size and two weights, and an edge from each even vertex to the next."""
    path, part = _file(s, "vertices.graph"), fx.table(s, d, "part")
    n = part.count()
    even = F.col("p_partkey") % 2 == 0
    mate = F.when(even & (F.col("p_partkey") + 1 < n), F.col("p_partkey") + 2).when(~even, F.col("p_partkey"))
    lines = part.select(F.col("p_partkey").alias("line"), F.concat_ws(" ", "p_size", "p_partkey", F.col("p_size") + 1, mate, F.when(mate.isNotNull(), F.lit(7))).alias("value"))
    head = s.range(1).select(F.lit(-1).cast("long").alias("line"), F.lit(f"{n} {n // 2} 111 2").alias("value"))
    text_files.write_lines(lines.unionByName(head), path)
    return matrix_files.read_metis(s, path)[1]


# Ends of file names and the formats that they stand for.
_NAMED = [("a.csr", "csr"), ("b/c.ijv", "ijv"), ("d.clu", "cluto"), ("e.graph", "metis"), ("f.METIS", "metis"), ("g.binrow", "binrow"), ("h.bincol/", "bincol"), ("i.bijv", "bijv"), ("j.txt", "csr"), ("k", "csr")]


@_query("src_formats", f"SELECT p_partkey, p_brand || '/' || path AS path, format FROM part JOIN (VALUES {', '.join(str((i, *x)) for i, x in enumerate(_NAMED))}) v(i, path, format) ON p_partkey % {len(_NAMED)} = i")
def _formats(s: SparkSession, d: str) -> DataFrame:
    ends = F.array(*[F.lit(end) for end, _ in _NAMED])
    rows = fx.table(s, d, "part").select("p_partkey", F.concat_ws("/", "p_brand", F.get(ends, (F.col("p_partkey") % len(_NAMED)).cast("int"))).alias("path"))
    return rows.withColumn("format", matrix_files.format_of("path"))


@_query("src_tensor", "SELECT c_nationkey::BIGINT AS k, l_partkey AS i, l_suppkey AS j, l_quantity AS v FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON o_orderkey = l_orderkey")
def _tensor(s: SparkSession, d: str) -> DataFrame:
    path = _file(s, "tensor.tns")
    fx.tensor(s, d).select(F.concat_ws(" ", F.col("k") + 1, F.col("i") + 1, F.col("j") + 1, "v").alias("value")).write.text(path)
    return text_files.read_tensor(s, path)


# --- lines, statistics, paths, PSSM


def _names_file(s: SparkSession, d: str) -> str:
    path = _file(s, "names.txt")
    text_files.write_lines(fx.table(s, d, "part").select(F.col("p_partkey").alias("line"), F.col("p_name").alias("value")), path)
    return path


@_query("src_lines", "SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS line, p_name AS value FROM part")
def _lines(s: SparkSession, d: str) -> DataFrame:
    return text_files.numbered_lines(s, _names_file(s, d))


@_query("src_file_stats", "SELECT count(*) AS n_lines, sum(n)::BIGINT AS n_tokens, max(n)::BIGINT AS max_tokens, sum(strlen(p_name) + 1)::BIGINT AS n_bytes FROM (SELECT p_name, len(list_filter(string_split(p_name, ' '), lambda x: x <> '')) AS n FROM part)")
def _stats(s: SparkSession, d: str) -> DataFrame:
    return text_files.file_stats(s, _names_file(s, d))


def _scalars(kind: str) -> None:
    @_query(f"src_scalars_{kind}", f"SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS line, (o_custkey - 700)::{kind} AS value FROM orders")
    def run(s: SparkSession, d: str) -> DataFrame:
        path = _file(s, "scalars.txt")
        text_files.write_lines(fx.table(s, d, "orders").select(F.col("o_orderkey").alias("line"), (F.col("o_custkey") - 700).cast("string").alias("value")), path)
        return text_files.read_scalars(s, path, kind)


for _kind in ("int", "bigint"):
    _scalars(_kind)


@_query(
    "src_path_parts",
    "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '' ELSE 'top/' || p_size END AS dir, p_brand || CASE WHEN p_size % 2 = 0 THEN '.tar.gz' ELSE '' END AS file, "
    "p_brand || CASE WHEN p_size % 2 = 0 THEN '.tar' ELSE '' END AS base, CASE WHEN p_size % 2 = 0 THEN 'gz' ELSE '' END AS ext FROM part",
)
def _paths(s: SparkSession, d: str) -> DataFrame:
    folder = F.when(F.col("p_size") % 3 == 0, "").otherwise(F.concat(F.lit("top/"), F.col("p_size").cast("string"), F.lit("/")))
    path = F.concat(folder, "p_brand", F.when(F.col("p_size") % 2 == 0, ".tar.gz").otherwise(""))
    rows = fx.table(s, d, "part").select("p_partkey", path.alias("path"))
    return rows.select("p_partkey", *[c.alias(n) for n, c in text_files.path_parts("path").items()])


@_query("src_paths", "SELECT * FROM (VALUES ('made', 1), ('folder', 1), ('folder is a file', 0), ('file', 1), ('bytes', (SELECT 4 * count(*) FROM part)), ('removed', 1), ('left', 0), ('bytes of nothing', -1)) v(what, n)")
def _folders(s: SparkSession, d: str) -> DataFrame:
    folder = _file(s, "a/b")
    made = text_files.make_path(s, folder)
    path = f"{folder}/keys.bin"
    records.write_array(fx.table(s, d, "part").select(F.col("p_partkey").alias("idx"), F.col("p_partkey").alias("value")), path, "i4")
    rows = [("made", made), ("folder", text_files.dir_exists(s, folder)), ("folder is a file", text_files.file_exists(s, folder)), ("file", text_files.file_exists(s, path)), ("bytes", text_files.file_bytes(s, path))]
    rows += [("removed", text_files.remove_path(s, folder)), ("left", text_files.dir_exists(s, folder)), ("bytes of nothing", text_files.file_bytes(s, path))]
    return s.createDataFrame([(what, int(n)) for what, n in rows], "what string, n int")


@_query(
    "src_pssm",
    "SELECT p_partkey::INT AS pos, chr(65 + p_size % 26) AS residue, (instr('ARNDCQEGHILKMFPSTWYVBZX*', chr(65 + p_size % 26)) - 1)::INT AS code, "
    "list_transform(range(20), lambda i: ((p_partkey + i) % 17 - 8)::INT) AS pssm, list_transform(range(20), lambda i: ((p_partkey * i) % 101)::INT) AS psfm FROM part",
)
def _pssm(s: SparkSession, d: str) -> DataFrame:
    path = _file(s, "profile.pssm")
    ints = lambda f: F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: f(i).cast("string"))
    key = F.col("p_partkey")
    line = F.concat_ws(" ", key, F.lower(F.char(65 + F.col("p_size") % 26)), F.concat(ints(lambda i: (key + i) % 17 - 8), ints(lambda i: (key * i) % 101)))
    head = s.range(1).select(F.lit(-1).cast("long").alias("line"), F.lit(" ".join(text_files.RESIDUES[:20])).alias("value"))
    text_files.write_lines(fx.table(s, d, "part").select(key.alias("line"), line.alias("value")).unionByName(head), path)
    return text_files.read_pssm(s, path)
