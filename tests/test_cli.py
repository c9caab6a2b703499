import pytest
from pyspark.sql import functions as F

from weftgraph.__main__ import main
from weftgraph.sources import matrix_files, records

EDGES = [(a, b) for a in range(5) for b in range(a + 1, 5)] + [(3, 3), (1, 0), (8, 9)]


def lines(spark, path):
    return sorted(r["value"] for r in spark.read.text(str(path)).collect())


def test_counts(spark, tmp_path, capsys):
    records.write_edges(spark.createDataFrame(EDGES, "src long, dst long"), str(tmp_path / "e.bin"))
    main(["tc", str(tmp_path / "e.bin"), "--probes"], spark)
    out = capsys.readouterr().out
    assert "There are 10 triangles" in out and "probes" in out
    main(["connected", str(tmp_path / "e.bin"), str(tmp_path / "c")], spark)
    assert lines(spark, tmp_path / "c") == ["0 0", "1 0", "2 0", "3 0", "4 0", "8 8", "9 8"]


def test_matrix_tools(spark, tmp_path):
    m = spark.range(12).select((F.col("id") % 4).alias("row"), (F.col("id") % 3).alias("col"), F.lit(2.0).alias("val"))
    matrix_files.write_matrix(m, str(tmp_path / "m.cluto"), "auto", 4, 3)
    main(["fis", str(tmp_path / "m.cluto"), str(tmp_path / "f"), "--minfreq", "4", "--minlen", "2"], spark)
    assert lines(spark, tmp_path / "f") == ["4 0 1", "4 0 1 2", "4 0 2", "4 1 2"]
    main(["convert", str(tmp_path / "m.cluto"), str(tmp_path / "m.csr"), "--cols", "1", "9", "--fraction", "1.0", "--compact", "--transpose"], spark)
    assert matrix_files.read_csr(spark, str(tmp_path / "m.csr")).count() == 12
    main(["neighbours", str(tmp_path / "m.csr"), str(tmp_path / "m.csr"), str(tmp_path / "n"), "--kind", "cos"], spark)
    assert len(lines(spark, tmp_path / "n")) == 9
    matrix_files.write_matrix(m.where("row < 3"), str(tmp_path / "g.ijv"), "auto", 3, 3)
    main(["pagerank", str(tmp_path / "g.ijv"), str(tmp_path / "p"), "--source", "1"], spark)
    assert len(lines(spark, tmp_path / "p")) == 3


def test_a_tool_is_needed(spark):
    with pytest.raises(SystemExit):
        main([], spark)
