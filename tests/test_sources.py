import os
import random
import re

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import edges
from weftgraph.sources import matrix_files as mf
from weftgraph.sources import records as rec
from weftgraph.sources import text_files as tf

random.seed(4)
PAIRS = sorted({(random.randrange(30), random.randrange(20)) for _ in range(120)})


def got(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def matrix(spark):
    return spark.createDataFrame([(a, b, (a * 7 + b) % 9 / 4 + 0.25) for a, b in PAIRS], "row long, col long, val double")


@pytest.mark.parametrize("fmt", ["csr", "cluto", "ijv", "bijv", "binrow", "bincol"])
@pytest.mark.parametrize("values", [True, False])
def test_matrix_round_trip(spark, tmp_path, matrix, fmt, values):
    path = str(tmp_path / f"x.{fmt}")
    mf.write_matrix(matrix, path, "auto", 30, 20, values)
    expected = matrix if values or fmt == "cluto" else matrix.withColumn("val", F.lit(1.0))
    assert got(mf.read_matrix(spark, path, values=values or fmt == "cluto")) == got(expected)


def test_metis_round_trip_and_errors(spark, tmp_path):
    both = {(x, y) for a, b in PAIRS if a != b for x, y in ((a, b), (b, a))}
    m = spark.createDataFrame([(a, b, 1.0) for a, b in both], "row long, col long, val double")
    mf.write_matrix(m, str(tmp_path / "g.metis"), "auto", 30, 30, values=False)
    entries, vertices = mf.read_metis(spark, str(tmp_path / "g.metis"))
    assert got(entries) == got(m) and vertices.count() == 30
    with pytest.raises(ValueError):
        mf.write_matrix(m, str(tmp_path / "h.metis"), "auto", 30, 20)
    (tmp_path / "w.graph").write_text("% note\n3 2 111 2\n1 5 6 2 7\n2 1 1 1 7 3 9\n4 0 0 2 9\n")
    entries, vertices = mf.read_metis(spark, str(tmp_path / "w.graph"))
    assert got(entries) == [(0, 1, 7.0), (1, 0, 7.0), (1, 2, 9.0), (2, 1, 9.0)]
    assert got(vertices) == [(0, 1.0, [5.0, 6.0]), (1, 2.0, [1.0, 1.0]), (2, 4.0, [0.0, 0.0])]
    (tmp_path / "bad.graph").write_text("2 2\n2\n1\n")
    with pytest.raises(ValueError):
        mf.read_metis(spark, str(tmp_path / "bad.graph"))
    (tmp_path / "neg.graph").write_text("2 1 1\n2 -3\n1 -3\n")
    with pytest.raises(ValueError):
        mf.read_metis(spark, str(tmp_path / "neg.graph"))


def test_formats_by_extension():
    assert mf.determine_format("a/b.graph") == "metis" and mf.determine_format("x") == "csr"
    with pytest.raises(ValueError):
        mf.determine_format("x", "nothing")


def test_formats_of_a_column_are_those_of_strings(spark):
    paths = [f"a/b.{e}" for e in mf.EXTENSIONS] + ["a.CSR", "x", "", "a.b/", "n.metis//", ".graph", "a.ijv.txt"]
    df = spark.createDataFrame([(p,) for p in paths] + [(None,)], "path string")
    found = {r["path"]: r["f"] for r in df.select("path", mf.format_of("path").alias("f")).collect()}
    assert found == {**{p: mf.determine_format(p) for p in paths}, None: "csr"}


def test_binary_edges(spark, tmp_path):
    e = spark.createDataFrame(PAIRS, "src long, dst long")
    path = str(tmp_path / "e.bin")
    rec.write_edges(e, path)
    with open(path, "ab") as f:
        f.write(b"\x01\x02\x03")  # trailing bytes are no edge
    assert got(rec.read_edges(spark, path)) == PAIRS
    assert got(rec.records(spark, path, "i4,i4", range_bytes=64).select("f0", "f1")) == PAIRS
    rec.write_clean_edges(e.toDF("u", "v"), str(tmp_path / "c.bin"))
    assert got(rec.read_clean_edges(spark, str(tmp_path / "c.bin"))) == PAIRS
    assert os.path.getsize(tmp_path / "c.bin") == 8 + 8 * len(PAIRS)


@pytest.mark.parametrize("kind", ["i4", "i8", "f4", "f8"])
def test_arrays(spark, tmp_path, kind):
    path = str(tmp_path / "a.bin")
    rec.write_array(spark.range(500).select(F.col("id").alias("idx"), (F.col("id") * 3).alias("value")), path, kind)
    assert [r["value"] for r in rec.read_array(spark, path, kind).orderBy("idx").collect()] == [3 * i for i in range(500)]
    with open(path, "ab") as f:
        f.write(b"x")
    with pytest.raises(ValueError):
        rec.read_array(spark, path, kind)


def test_text_readers(spark, tmp_path):
    (tmp_path / "t.txt").write_text("a b\tc\n\nd e\n")
    assert tuple(tf.file_stats(spark, str(tmp_path / "t.txt")).first()) == (3, 5, 3, 11)
    assert got(tf.numbered_lines(spark, str(tmp_path / "t.txt"))) == [(0, "a b\tc"), (1, ""), (2, "d e")]
    (tmp_path / "n.txt").write_text("5\n7\n")
    assert got(tf.read_scalars(spark, str(tmp_path / "n.txt"))) == [(0, 5), (1, 7)]
    (tmp_path / "p.txt").write_text("A R N\n1 r " + " ".join(map(str, range(40))) + "\n")
    row = tf.read_pssm(spark, str(tmp_path / "p.txt")).first()
    assert (row["pos"], row["residue"], row["code"], row["psfm"][0]) == (1, "R", 1, 20)
    (tmp_path / "k.txt").write_text("1 2 3 4.5\n")
    assert got(tf.read_tensor(spark, str(tmp_path / "k.txt"))) == [(0, 1, 2, 4.5)]
    assert tf.file_exists(spark, str(tmp_path / "k.txt")) and tf.dir_exists(spark, str(tmp_path))


def test_path_parts(spark):
    df = spark.createDataFrame([("a/b/c.tar.gz",), ("x",)], "p string")
    p = tf.path_parts("p")
    assert got(df.select(p["dir"], p["file"], p["base"], p["ext"])) == [("", "x", "x", ""), ("a/b", "c.tar.gz", "c.tar", "gz")]


def test_lines_keep_their_order(spark, tmp_path):
    rows = spark.range(1000).select((1000 - F.col("id")).alias("line"), F.concat(F.lit("v"), 1000 - F.col("id")).alias("value")).repartition(7)
    tf.write_lines(rows, str(tmp_path / "o"))
    back = tf.numbered_lines(spark, str(tmp_path / "o")).orderBy("line").collect()
    assert [r["value"] for r in back] == [f"v{i + 1}" for i in range(1000)]


def test_numbering_lines_exchanges_no_text(spark, tmp_path):
    lines = {f"f{k}": [f"{k}-{i}" + "x" * (i % 50) for i in range(900 * k)] for k in (0, 1, 3, 2)}
    for name, rows in lines.items():
        (tmp_path / name).write_text("".join(f"{r}\n" for r in rows))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 8192)  # many splits a file
    spark.conf.set("spark.sql.files.openCostInBytes", 100)
    try:
        whole, odd = tf.numbered_lines(spark, str(tmp_path)), tf.numbered_lines(spark, str(tmp_path), F.expr("length(value) % 2 = 1"))
        want = [r for name in sorted(lines) for r in lines[name]]
        assert got(whole) == list(enumerate(want))
        assert got(odd) == list(enumerate(r for r in want if len(r) % 2))
        plan = whole._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastExchange" in plan and "rangepartitioning" not in plan and "hashpartitioning" not in plan
        tf.SPLITS, kept = 1, tf.SPLITS
        try:
            assert got(tf.numbered_lines(spark, str(tmp_path))) == list(enumerate(want))
        finally:
            tf.SPLITS = kept
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "empty.txt").write_text("")
    assert tf.numbered_lines(spark, str(tmp_path / "none")).count() == 0


def test_clean_after_read(spark, tmp_path):
    e = spark.createDataFrame([(1, 2), (2, 1), (3, 3)], "src long, dst long")
    rec.write_edges(e, str(tmp_path / "d.bin"))
    assert got(edges.clean(rec.read_edges(spark, str(tmp_path / "d.bin")))) == [(1, 2)]


def test_integers_that_do_not_fit_raise(spark, tmp_path):
    far = spark.createDataFrame([(1, 2**31 + 5)], "src long, dst long")
    empty = spark.createDataFrame([(1, None)], "src long, dst long")
    for e in (far, empty):
        with pytest.raises(Exception, match="fit|nulls"):
            rec.write_edges(e, str(tmp_path / "x.bin"))
    with pytest.raises(Exception, match="fit"):
        rec.write_array(spark.range(1).select(F.col("id").alias("idx"), F.lit(-(2**31) - 1).alias("value")), str(tmp_path / "y.bin"), "i4")
    with pytest.raises(Exception, match="fit"):
        mf.write_matrix(far.toDF("row", "col").withColumn("val", F.lit(1.0)), str(tmp_path / "z.binrow"), "auto", 2, 2)
    edge = [(2**31 - 1, 0), (0, 2**31 - 1)]
    rec.write_edges(spark.createDataFrame(edge, "src long, dst long"), str(tmp_path / "w.bin"))
    assert got(rec.read_edges(spark, str(tmp_path / "w.bin"))) == sorted(edge)


def test_files_are_written_in_parallel_and_in_order(spark, tmp_path):
    rows = spark.range(20_000).select(((F.col("id") * 7919) % 20_011).alias("src"), F.col("id").alias("dst")).repartition(9)
    rec.write_edges(rows, str(tmp_path / "p.bin"))
    back = rec.records(spark, str(tmp_path / "p.bin"), "i4,i4").orderBy("idx").collect()
    assert [(r["f0"], r["f1"]) for r in back] == sorted((i * 7919 % 20_011, i) for i in range(20_000))
    rec.write_edges(rows.limit(0), str(tmp_path / "e.bin"))
    assert os.path.getsize(tmp_path / "e.bin") == 0 and rec.read_edges(spark, str(tmp_path / "e.bin")).count() == 0


@pytest.mark.parametrize("parts", [False, True])
def test_a_failed_write_leaves_what_was_there(spark, tmp_path, parts):
    path, rows = str(tmp_path / "kept.bin"), spark.range(5000).select("id", (F.col("id") * 3).alias("x")).repartition(7)
    rec.write_records(rows, path, ["id", "x"], "i4,i8", ["id"], counted=True, parts=parts)
    want = [(i, i, 3 * i) for i in range(5000)]
    assert got(rec.read_counted(spark, path, "i4,i8")) == want and rec.file_size(path) == 8 + 12 * 5000
    far = rows.withColumn("x", F.when(F.col("id") == 4321, 2**40).otherwise(0))
    with pytest.raises(Exception, match="fit"):
        rec.write_records(far, path, ["id", "x"], "i4,i4", ["id"], counted=True, parts=parts)
    assert got(rec.read_counted(spark, path, "i4,i8")) == want
    files = list((tmp_path / "kept.bin").iterdir()) if parts else list(tmp_path.iterdir())
    assert parts or [f.name for f in files] == ["kept.bin"]
    rec.write_records(rows.where("id < 9"), path, ["id", "x"], "i4,i8", ["id"], counted=True, parts=parts)
    assert got(rec.read_counted(spark, path, "i4,i8")) == want[:9]
    rec.write_records(rows.limit(0), path, ["id", "x"], "i4,i8", ["id"], counted=True, parts=parts)
    assert rec.read_counted(spark, path, "i4,i8").count() == 0


def test_the_sink_is_a_format(spark, tmp_path):
    path = str(tmp_path / "made")
    spark.dataSource.register(rec.PackedRecords)
    rows = spark.range(0, 1000, 1, 6).select(F.col("id").cast("int").alias("a"), (F.col("id") / 4).alias("b"))
    writer = lambda: rows.write.format("weft_records").option("kinds", "i4,f8")
    writer().mode("overwrite").save(path)
    writer().mode("overwrite").save(path)
    assert got(rec.records(spark, path, "i4,f8", range_bytes=500)) == [(i, i, i / 4) for i in range(1000)]
    assert len(list((tmp_path / "made").iterdir())) == 8  # six parts, head and manifest
    with pytest.raises(Exception, match="overwrite"):
        writer().mode("append").save(path)


def test_values_of_csr_lines(spark, tmp_path):
    (tmp_path / "m.csr").write_text("1 5 2 6\n\n3 7\n")
    p = str(tmp_path / "m.csr")
    assert got(mf.read_csr(spark, p)) == [(0, 1, 5.0), (0, 2, 6.0), (2, 3, 7.0)]
    assert got(mf.read_csr(spark, p, None)) == [(0, 1), (0, 2), (0, 5), (0, 6), (2, 3), (2, 7)]


def test_lists_of_lines_are_made_in_as_many_tasks_as_entries_ask_for(spark, tmp_path, monkeypatch):
    rows = [(i, (i * 7 + k) % 90, float(k + 1)) for i in range(90) for k in range(4)]
    m = spark.createDataFrame(rows, "row long, col long, val double")
    plans, write = [], mf.write_lines

    def seen(lines, path):
        plans.append(lines._jdf.queryExecution().executedPlan().toString())
        write(lines, path)

    monkeypatch.setattr(mf, "write_lines", seen)
    monkeypatch.setattr(mf, "PER_TASK", 10)
    mf.write_matrix(m, str(tmp_path / "g.metis"), "auto", 90, 90)
    assert re.search(r"hashpartitioning\(row#\d+L, 36\), REPARTITION_BY_NUM", plans[0])
    assert got(mf.read_metis(spark, str(tmp_path / "g.metis"))[0]) == got(m)
