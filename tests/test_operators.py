"""Operators whose answers SQL can't give or whose edges the data don't show."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import sequence as Q
from quillon.functions import text as X
from quillon.operators import evidence as E
from quillon.operators import graph as G
from quillon.operators import relational as R
from quillon.operators import statistics as S
from quillon.sources import files, sinks
from quillon.streaming import queue


def test_identifiers_are_checked():
    assert R.check_identifier("a.b_1") == "a.b_1"
    for bad in ("", "a b", "a;", "1a", "a.b.c", "a--"):
        with pytest.raises(ValueError):
            R.check_identifier(bad)


def test_page_tells_of_more(spark):
    df = spark.range(10).toDF("x")
    assert {r.truncated for r in R.page(df, [F.col("x")], 4, 2).collect()} == {True}
    assert [r.x for r in R.page(df, [F.col("x")], 4, 6).orderBy("x").collect()] == [6, 7, 8, 9]
    assert {r.truncated for r in R.page(df, [F.col("x")], 4, 6).collect()} == {False}
    with pytest.raises(ValueError):
        R.only_one(df)
    assert R.only_one(df.where("x = 3")).count() == 1


def test_filters_are_named_when_ignored(spark):
    df, applied, ignored = R.apply_filters(spark.range(5), {"id": 2, "nope": 1})
    assert df.count() == 1 and applied == ["id"] and ignored == ["nope"]


def test_wildcards_are_ordinary(spark):
    df = spark.createDataFrame([("50%",), ("50x",), ("A_B",), ("aXb",)], "s string")
    assert [r.s for r in df.where(R.contains_any("0%", "s")).collect()] == ["50%"]
    assert [r.s for r in df.where(R.contains_any("a_b", "s")).collect()] == ["A_B"]


def test_t_distribution():
    t = np.array([0.0, 1.0, 2.0, 12.706204736, 2.228138852, 1.959963985])
    df = np.array([5.0, 1.0, 2.0, 1.0, 10.0, 1e6])
    assert S.t_two_sided(t, df) == pytest.approx([1.0, 0.5, 0.18350341907, 0.05, 0.05, 0.05], abs=1e-6)


def test_gamma_family():
    assert S.digamma(1.0) == pytest.approx(-0.5772156649015329, abs=1e-12)
    assert S.trigamma(1.0) == pytest.approx(math.pi**2 / 6, abs=1e-12)
    for x in (0.3, 1.0, 7.5, 90.0):
        assert S.trigamma_inverse(S.trigamma(x)) == pytest.approx(x, rel=1e-9)
    assert S.normal_quantile(0.975) == pytest.approx(1.959963984540054, abs=1e-9)
    assert S.variance_prior(0.0, 0.01, 4.0)[1] == math.inf


def test_variance_prior_finds_what_made_the_data():
    rng = np.random.default_rng(3)
    d0, s0, df = 8.0, 0.3, 4.0
    sigma2 = s0 * d0 / rng.chisquare(d0, 200_000)
    logs = np.log(sigma2 * rng.chisquare(df, 200_000) / df)
    got_s0, got_d0 = S.variance_prior(float(logs.mean()), float(logs.var(ddof=1)), df)
    assert got_d0 == pytest.approx(d0, rel=0.1) and got_s0 == pytest.approx(s0, rel=0.05)


def test_bh_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, 0.01), (2, 0.02), (3, 0.02), (4, 0.5), (5, None)], "id int, p double").withColumn("g", F.lit(1))
    got = {r.id: r.q for r in S.benjamini_hochberg(df, ["g"], "p", "id").collect()}
    assert got[1] == pytest.approx(0.08 / 3) and got[2] == got[3] == pytest.approx(0.08 / 3) and got[4] == 0.5 and got[5] is None


def test_robust_z_of_a_flat_group(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 9.0)], "g string, x double")
    assert {r.z for r in S.robust_z(df, ["g"], "x").collect()} == {0.0}


def test_evidence_rules(spark):
    items = [(1, "direct_perturbation", None), (2, "direct_perturbation", 1), (2, "direct_biochemical", 2), (3, "correlative_omics", 1), (4, "computational_model", 1), (5, "literature_assertion", 1), (6, "direct_perturbation", 1)]
    rows = [(i, a, k, "increases", g, i, "active") for i, (a, k, g) in enumerate(items)]
    ev = spark.createDataFrame(rows, "evidence_id int, assertion_id int, evidence_type string, direction string, independent_group int, publication_id int, status string")
    a = spark.createDataFrame([(i, "L3" if i == 5 else None, i == 6) for i in range(1, 8)], "assertion_id int, level_override string, open_conflict boolean")
    got = {r.assertion_id: (r.level, r.derived_reason) for r in E.evidence_levels(a, ev).collect()}
    weak = "hypothesis_or_insufficient_support"
    assert got == {1: ("L1", "direct_evidence"), 2: ("L2", "direct_evidence_replicated"), 3: ("L5", weak), 4: ("L4", "computational_only"), 5: ("L3", weak), 6: (None, "direct_evidence_discordant"), 7: (None, "no_evidence")}


def test_codes(spark):
    df = spark.createDataFrame([("ATGCTUTGATAAX", "acgtn")], "s string, d string")
    got = df.select(Q.translate(F.col("s"), 1).alias("one"), Q.translate(F.col("s"), 3).alias("three"), Q.translate(F.col("s"), 1, True).alias("stop"), Q.reverse_complement(F.col("d")).alias("rc")).first()
    assert tuple(got) == ("ML**", "MTW*", "ML", "NACGT")
    one, three, safe = Q.code(1), Q.code(3), Q.recode_map("dual_safe")
    assert all(one[safe[c]] == one[c] == three[safe[c]] for c in one)
    assert not {"CGA", "CGC"} & set(safe.values()) and safe["CTG"] == "TTA" and safe["TTG"] == "TTG"
    there = Q.recode_map("to_table3")
    assert all(three[there[c]] == one[c] for c in one) and there["ATA"] == "ATT"
    back = Q.recode_map("to_table1", 3)
    assert all(one[back[c]] == three[c] for c in one)
    r = df.select(Q.recode_report(F.lit("ATGCTTCGATGA")).alias("r")).first().r
    assert tuple(r) == ("ATGTTAAGATAA", 3, 4, 0, 0, True)
    with pytest.raises(ValueError):
        Q.recode_map("nuclear")


def test_text_normal_form(spark):
    df = spark.createDataFrame([("  ＡＢ—c ﬁ ",), (None,), ("",)], "s string")
    assert [r.n for r in df.select(X.nfkc("s").alias("n")).collect()] == ["ab-c fi", None, ""]
    v = spark.createDataFrame([("abcabc", 3, "abc"), ("abcx", 1, "abc"), ("aa", 5, "a"), ("x", 0, "y"), (None, 0, "y")], "t string, at int, q string")
    assert [r.v for r in v.select(X.span_verdict(F.col("t"), F.col("at"), F.col("q")).alias("v")).collect()] == ["exact", "moved", "ambiguous", "absent", "no_text"]


def test_division_and_power_set(spark):
    have = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "owner int, item string")
    want = spark.createDataFrame([("w", "a"), ("w", "b"), ("v", "a")], "wish string, item string")
    assert {tuple(r) for r in G.relational_division(have, want, "owner", "item", "wish").collect()} == {("w", 1), ("v", 1), ("v", 2)}
    assert sorted(r.size for r in G.power_set(have, "item").collect()) == [0, 1, 1, 2]


def test_files(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("# note\nk\tv\nx\t\ny\t0\n")
    assert [tuple(r) for r in files.read_tsv(spark, str(tmp_path / "a.tsv")).collect()] == [("x", None), ("y", "0")]
    (tmp_path / "m.tsv").write_text("gene\ts1\ts2\ng1\t1\t2\ng2\t0\t5\n")
    assert files.matrix_samples(spark, str(tmp_path / "m.tsv")) == ["s1", "s2"]
    assert {tuple(r) for r in files.read_matrix(spark, str(tmp_path / "m.tsv"), ["s2"]).collect()} == {("g1", "s2", 2.0), ("g2", "s2", 5.0)}
    (tmp_path / "a.gff3").write_text("##gff-version 3\nc1\tx\tgene\t11\t40\t.\t+\t.\tID=g1;Alias=p,q\nc1\tx\tCDS\t12\t20\t.\t+\t0\tID=c;Parent=g1;Note=a%2Cb,\"c;Note=d+e\n")
    got = {r.id: r for r in files.read_gff3(spark, str(tmp_path / "a.gff3")).collect()}
    assert got["c"].attributes["Note"] == ["a,b", '"c', "d+e"]
    assert got["g1"].start == 10 and got["c"].owner == "g1" and got["g1"].attributes["Alias"] == ["p", "q"]
    assert files.gene_records(files.read_gff3(spark, str(tmp_path / "a.gff3"))).first().features == 2
    (tmp_path / "a.fa").write_text(">one first > seq\nacgt\nAC\n>two\nTT\n")
    assert {tuple(r) for r in files.read_fasta(spark, str(tmp_path / "a.fa")).collect()} == {("one", "first > seq", "ACGTAC"), ("two", "", "TT")}
    (tmp_path / "a.gaf").write_text("!gaf-version: 2.2\n" + "\t".join(["DB", "S1", "G", "NOT|part_of", "GO:1", "PMID:1", "IMP", "", "P", "", "", "gene", "t", "d", "DB", "", ""]) + "\n")
    assert files.read_gaf(spark, str(tmp_path / "a.gaf")).first().negated
    (tmp_path / "a.gb").write_text('LOCUS X\nFEATURES             Location/Qualifiers\n     gene            complement(join(5..9,\n                     12..20))\n                     /gene="abc"\n                     /note="two words\n                     more"\nORIGIN\n')
    r = files.read_genbank(spark, str(tmp_path / "a.gb")).first()
    assert (r.key, r.start, r.end, r.strand, r.qualifiers["gene"], r.qualifiers["note"]) == ("gene", 4, 20, -1, "abc", "two words more")


def test_release_digest_ignores_order(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "R"), (2, None, "R"), (3, "c", "I")], "id int, v string, zone string")
    a = {tuple(r) for r in sinks.write_release(df, str(tmp_path / "r"), ["id"]).collect()}
    assert a == {tuple(r) for r in sinks.write_release(df.orderBy(F.desc("id")), str(tmp_path / "s"), ["id"]).collect()}
    back = {r.id: r._absence for r in spark.read.json(str(tmp_path / "r")).collect()}
    assert back == {1: [], 2: ["v"], 3: []}
    assert sinks.write_result(df, str(tmp_path / "t"), {"b": 1, "a": 2}).first().parameters == "a=2;b=1"


def test_stream_enqueues_once(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    df.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        queue.enqueue(stream, str(tmp_path / "out"), ["k"], str(tmp_path / "check")).awaitTermination()
        df.where("k = 2").write.mode("append").parquet(str(tmp_path / "in"))
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]
