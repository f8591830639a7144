"""Annotation readers and code selection."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillon.functions import sequence as Q
from quillon.sources import annotations as A


def test_exports(spark, tmp_path):
    (tmp_path / "f.tab").write_text("S1\tORF\tVerified\tY1\tABC1\tx|y\tchr\t\t12\t900\t100\tC\t\t\t\tdoes things\n")
    r = A.read_features(spark, str(tmp_path / "f.tab"), aliases=True).first()
    assert (r.low, r.high, r.forward, r.aliases) == (99, 900, False, ["x", "y"])
    (tmp_path / "u.tsv").write_text("Entry\tCofactor\tPlace\nP1\tCOFACTOR: Name=Mg(2+); Xref=ChEBI:1; Name=FAD; Xref=2;\tSUBCELLULAR LOCATION: Mitochondrion {ECO:1}. Cytoplasm.\n")
    df, missing = A.read_by_heading(spark, str(tmp_path / "u.tsv"), {"Entry": "id", "Cofactor": "c", "Place": "p", "EC": "ec"})
    r = df.select("id", A.cofactors(F.col("c")).alias("c"), A.locations(F.col("p")).alias("p")).first()
    assert (r.id, r.c, r.p, missing) == ("P1", ["Mg(2+)", "FAD"], ["Mitochondrion", "Cytoplasm"], ["EC"])
    (tmp_path / "k.txt").write_text("g:1\tCDS\tI:1..9\tPAU8, P2; a protein\ng:2\tonly text\n")
    got = {r.id: r for r in A.read_list(spark, str(tmp_path / "k.txt")).collect()}
    assert got["g:1"].symbols == ["PAU8", "P2"] and got["g:1"].description == "a protein" and got["g:2"].symbols is None and got["g:2"].description == "only text"
    (tmp_path / "l.txt").write_text("g:1\tpath:00010\n\n")
    assert [tuple(r) for r in A.read_links(spark, str(tmp_path / "l.txt")).collect()] == [("1", "00010")]
    (tmp_path / "r.csv").write_text("Run,spots,bases\nR1,10,\nRun,spots,bases\nR2,x,7\n")
    assert [tuple(r) for r in A.read_runinfo(spark, str(tmp_path / "r.csv")).orderBy("Run").collect()] == [("R1", 10, None), ("R2", None, 7)]


def test_urls(spark):
    df = spark.createDataFrame([(5,)], "x int")
    assert df.select(A.fill_url("https://h/{x}/y", {"x": F.col("x")}).alias("u")).first().u == "https://h/5/y"
    with pytest.raises(ValueError):
        A.fill_url("https://h/{z}", {})


def test_code_is_never_guessed(spark):
    genomes = {"cytosol": ("nuclear",), "matrix": ("nuclear", "mitochondrial")}
    assert Q.table_for("cytosol", None, genomes) == 1 and Q.table_for("matrix", "mitochondrial", genomes) == 3
    for bad in (("matrix", None), ("cytosol", "mitochondrial"), ("moon", None)):
        with pytest.raises(ValueError):
            Q.table_for(*bad, genomes)
    df = spark.createDataFrame([(4, "nuclear", 1), (None, "mitochondrial", 1), (None, None, 1), (None, None, None)], "a int, g string, d int")
    assert [tuple(r.c) for r in df.select(Q.code_source(F.col("a"), F.col("g"), F.col("d")).alias("c")).collect()] == [(4, "annotation"), (3, "genome"), (1, "declared"), (None, "none")]
    s = spark.createDataFrame([("ATGTGA",), ("GCTGCT",)], "s string").select(Q.safety(F.col("s"), 1, 3).alias("x")).collect()
    assert [r.x.safe for r in s] == [False, True]


def test_a_quote_is_a_character_like_others(spark, tmp_path):
    line = lambda i, name: "\t".join([f"S{i}", "ORF", "", f"Y{i}", name, "", "", "", "1", "10", "20", "W", "", "", "", "d"])
    (tmp_path / "f.tab").write_text("\n".join([line(1, '"open'), line(2, "plain"), line(3, 'also"')]) + "\n")
    assert [r.feature_id for r in A.read_features(spark, str(tmp_path / "f.tab")).orderBy("feature_id").collect()] == ["S1", "S2", "S3"]
