"""Command line: ``python -m weftgraph TOOL ...`` (X5, X6 and the matrix tools)."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import components, edges, graph, matrix, mining, similarity, triangles
from weftgraph.session import get_spark, reach
from weftgraph.sources import matrix_files, records, results, text_files


def _graph(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Clean edges of a file: raw pairs, counted clean pairs, METIS, or 1-based lines."""
    if kind == "raw":
        return edges.clean(records.read_edges(spark, path))
    if kind == "bin":
        return edges.clean(records.read_clean_edges(spark, path), "u", "v")
    entries = matrix_files.read_metis(spark, path)[0] if kind == "metis" else matrix_files.read_ijv(spark, path, one_based=True)
    return edges.clean(entries, "row", "col")


def _shape(m: DataFrame) -> tuple[int, int]:
    row = m.agg((F.max("row") + 1).alias("r"), (F.max("col") + 1).alias("c")).first()
    return row["r"] or 0, row["c"] or 0


def tc(spark: SparkSession, a: argparse.Namespace) -> None:
    began = time.perf_counter()
    g = _graph(spark, a.file, a.type)
    n = triangles.triangle_count(g, a.plan).first()[0]
    print(f"There are {n} triangles in the input graph ({time.perf_counter() - began:.3f} s).")
    if a.probes:
        print(f"{triangles.probe_count(g).first()[0]} probes")


def fis(spark: SparkSession, a: argparse.Namespace) -> None:
    m = matrix_files.read_cluto(spark, a.file)
    tx = m.select(F.col("row").alias("tid"), F.col("col").alias("item"))
    sets = mining.frequent_itemsets(tx, a.minfreq, a.maxfreq, a.minlen, a.maxlen)
    results.itemset_lines(sets).write.text(a.output)


def pagerank(spark: SparkSession, a: argparse.Namespace) -> None:
    m = matrix_files.read_matrix(spark, a.file, a.format).toDF("src", "dst", "w")
    restart = spark.range(1).select(F.lit(a.source - 1).cast("long").alias("id"), F.lit(1.0).alias("r")) if a.source else None
    pr, rounds = graph.pagerank(m, a.follow, a.eps, a.rounds, restart)
    print(f"{rounds} rounds", file=sys.stderr)
    text_files.write_lines(results.rank_lines(pr), a.output, line="id")


def convert(spark: SparkSession, a: argparse.Namespace) -> None:
    """Prune columns, prune rows, low-filter rows, compact, shuffle, transpose, write: in this order."""
    m = matrix_files.read_matrix(spark, a.file, a.format)
    if a.cols:
        m = matrix.prune(m, "col", *a.cols)
    if a.rows:
        m = matrix.prune(m, "row", *a.rows)
    if a.fraction is not None:
        m = matrix.normalise(matrix.low_filter(m, "row", 2, a.fraction))
    if a.compact:
        m = matrix.compact_columns(m)
    if a.shuffle is not None:
        m = matrix.shuffle(m, "row", a.shuffle)
    if a.transpose:
        m = matrix.transpose(m)
    matrix_files.write_matrix(m, a.output, a.to, *_shape(m))


def neighbours(spark: SparkSession, a: argparse.Namespace) -> None:
    q, c = (matrix_files.read_csr(spark, p) for p in (a.queries, a.file))
    found = similarity.neighbours(q, c, a.kind, a.k, a.least)
    results.neighbour_lines(found).write.text(a.output)


def connected(spark: SparkSession, a: argparse.Namespace) -> None:
    found = components.connected_components(_graph(spark, a.file, a.type), "u", "v")
    text_files.write_lines(found.select("id", F.concat_ws(" ", "id", "component").alias("value")), a.output, line="id")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    p = argparse.ArgumentParser(prog="weftgraph", description=__doc__)
    sub = p.add_subparsers(required=True)

    def tool(f, *options: tuple) -> None:
        q = sub.add_parser(f.__name__, help=f.__doc__)
        q.set_defaults(run=f)
        for name, kwargs in options:
            q.add_argument(name, **kwargs)

    file, output = ("file", {}), ("output", {})
    kind = ("--type", {"choices": ["raw", "bin", "metis", "tsv"], "default": "raw"})
    fmt = ("--format", {"default": "auto"})
    tool(tc, file, kind, ("--plan", {"choices": triangles.PLANS, "default": "adjacency"}), ("--probes", {"action": "store_true"}))
    tool(fis, file, output, *[(f"--{n}", {"type": int, "default": d}) for n, d in (("minfreq", 10), ("maxfreq", -1), ("minlen", 1), ("maxlen", -1))])
    tool(pagerank, file, output, fmt, ("--follow", {"type": float, "default": 0.85}), ("--eps", {"type": float, "default": 1e-10}), ("--rounds", {"type": int, "default": 100}), ("--source", {"type": int, "help": "1-based vertex to restart at"}))
    pair = {"nargs": 2, "type": int, "metavar": ("LEAST", "MOST")}
    tool(convert, file, output, fmt, ("--to", {"default": "csr"}), ("--cols", pair), ("--rows", pair), ("--fraction", {"type": float}), ("--compact", {"action": "store_true"}), ("--shuffle", {"type": int, "metavar": "SEED"}), ("--transpose", {"action": "store_true"}))
    tool(neighbours, ("queries", {}), file, output, ("--kind", {"choices": similarity.KINDS, "default": "jac"}), ("-k", {"type": int, "default": 100}), ("--least", {"type": float, "default": 0.25}))
    tool(connected, file, output, kind)
    args = p.parse_args(argv)
    args.run(reach(spark or get_spark()), args)


if __name__ == "__main__":
    main()
