"""Steps whose cost must not outgrow the input, on small tables."""

from __future__ import annotations

import random

from quillon import registry
from quillon.operators import evidence as E
from quillon.operators import graph as G
from quillon.operators import provenance as P
from quillon.operators import relational as R
from quillon.operators import search as L
from quillon.operators import statistics as S
from quillon.sources.standins import Tables

registry.load()


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_division_meets_by_two_items_and_size(spark):
    r = random.Random(1)
    sets = lambda n, most: {i: frozenset(r.sample("abcdefghijkl", r.randint(1, most))) for i in range(n)}
    have, want = sets(200, 9), sets(60, 4) | {60: frozenset("az"), 61: frozenset("z")}
    frame = lambda s, names: spark.createDataFrame([(i, x) for i, v in s.items() for x in v], names)
    got = G.relational_division(frame(have, "owner int, item string"), frame(want, "wish int, item string"), "owner", "item", "wish")
    assert sorted(tuple(x) for x in got.collect()) == sorted((w, o) for w, v in want.items() for o, h in have.items() if v <= h)
    assert "_band" in plan(got) and "_key" in plan(got)


def test_pairs_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 4)
    rows = [("a", i, i % 3) for i in range(50)] + [("b", 1, 0), ("b", 2, 1), (None, 3, 0), (None, 4, 0), ("a", None, 0)]
    got = R.pairs_within(spark.createDataFrame(rows, "g string, id int, v int"), ["g"], "id").where("x.v <> y.v").select("g", "x.id", "y.id").collect()
    ids = {g: {i: v for h, i, v in rows if h == g and i is not None} for g in "ab"}
    want = sorted((g, i, j) for g, d in ids.items() for i in d for j in d if i < j and d[i] != d[j])
    assert sorted((g, min(i, j), max(i, j)) for g, i, j in got) == want


def test_pairs_of_keys_in_few_tiles(spark, monkeypatch):
    monkeypatch.setattr(R, "KEYS", 4)
    monkeypatch.setattr(R, "PACKED", 8)
    monkeypatch.setattr(R, "BLOCKS", 6)
    rows = [("a", i * i % 211, "uvw"[i % 3]) for i in range(90)] + [("b", 1, "u"), ("b", 2, "v"), ("b", 2, "u"), (None, 3, "u"), (None, 4, "v"), ("a", None, "u"), ("a", 5, None)] + [("c", 7, "u"), ("c", 7, "v")] * 9
    got = R.keys_unlike(spark.createDataFrame(rows, "g string, id long, v string"), ["g"], "id", "v")
    want = sorted((g, i, j) for g, i, v in rows for h, j, w in rows if None not in (g, i, j, v, w) and g == h and i < j and v != w)
    assert sorted(map(tuple, got.collect())) == want
    # values of one key each: rows meet
    own = R.keys_unlike(spark.createDataFrame([(g, i, str(n)) for n, (g, i, _) in enumerate(rows)], "g string, id long, v string"), ["g"], "id", "v")
    assert "explode(_a" not in plan(own) and sorted(map(tuple, own.collect())) == sorted((g, i, j) for g, i, _ in rows for h, j, _ in rows if None not in (g, i, j) and g == h and i < j)
    # a row is copied into one tile more than there may be blocks, and the explodes aren't compiled with the join
    tiles = {(r.g, r._low, r._high) for r in R._meet(*[R._in_blocks(spark.createDataFrame(rows, "g string, id long, v string"), ["g"], "id", 4)[0].withColumnRenamed("id", c) for c in ("a", "b")], ["g"], 4).collect()}
    assert {t for t in tiles if t[0] == "a"} == {("a", i, j) for i in range(6) for j in range(i, 6)}
    text = got._jdf.queryExecution().executedPlan().toString()
    assert text.index("Generate explode(_a") < text.index("Project [g", text.index("Generate explode(_a")) < text.index("SortMergeJoin")


def test_underpowered_has_every_gene(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    assert registry.QUERIES["underpowered"](spark, "/root/testdata/sf0.001").count() == t.v_matrix.select("gene").distinct().count() > 1


def test_all_rules_of_a_contrast(spark):
    # experiment, axis, contexts of the sides, samples of the sides, reasons
    ok = ("genotype", 1, 1, [1, 2], [3, 4])
    cases = [
        (ok, ""),
        (("genotype", 1, 1, [1, 2], []), "empty_side,no_strain"),
        (("genotype", 1, 1, [1, 2], [2, 3]), "repeated_sample"),
        (("genotype", 1, 1, [1, 98, 97, 96], [3, 95, 94]), "not_in_atlas"),
        (("genotype", 1, 1, [1, 10], [3, 11]), "quarantined"),
        (("genotype", 1, 1, [1, 5], [3, 4]), "no_context"),
        (("time", None, 2, [1, 2], [3, 4]), "group_without_context"),
        (("genotype", 1, 2, [1, 2], [3, 4]), "genotype_across_contexts"),
        (("genotype", None, None, [1, 2], [3, 4]), "group_without_context,genotype_across_contexts"),
        (("genotype", 1, 1, [6], [3]), "no_strain"),
        (("genotype", 1, 1, [1], [2]), "same_strain"),
        (("genotype", 1, 1, [1, 3], [2]), ""),
        (("time", 1, 1, [1], [2]), "no_axis"),
        (("time", 1, 2, [1], [2]), ""),
        (("time", 1, 2, [1], [8]), "several_studies"),
        (("time", 1, 2, [1], [9]), "several_organisms"),
        (("genotype", 1, 1, [12], [3]), ""),
    ]
    rows = [(i, axis, rc, tc, side, n, x) for i, ((axis, rc, tc, a, b), _) in enumerate(cases) for side, ids in (("reference", a), ("treatment", b)) for n, x in enumerate(ids)]
    members = spark.createDataFrame(rows, "e long, axis string, reference_context long, treatment_context long, side string, line int, sample_id long")
    strain = {1: 1, 2: 1, 3: 2, 4: 2, 5: 1, 6: None, 8: 1, 9: 1, 10: 1, 11: 2, 12: 1}
    samples = spark.createDataFrame([(i, None if i == 5 else 7, s) for i, s in strain.items()], "sample_id long, context_id long, strain_id long")
    flags = spark.createDataFrame([(11, "quarantine", "confirmed", "x" * 300), (10, "quarantine", "active", "bad"), (12, "quarantine", "resolved", "old"), (12, "note", "active", "mild")], "target_id long, severity string, status string, rationale string")
    runs = spark.createDataFrame([(i, "S2" if i == 8 else "S1", "B" if i == 9 else "A") for i in strain if i != 4], "sample_id long, study string, organism string")
    got = {r.e: r for r in S.refusals(members, samples, flags, runs, "e").collect()}
    assert [got[i].reasons for i in range(len(cases))] == [want for _, want in cases]
    details = {case[1]: got[i].details for i, case in enumerate(cases)}
    assert details["not_in_atlas"] == "not_in_atlas 5: 98, 97, 96, 95"
    assert details["quarantined"] == "quarantined 10 bad, 11 " + "x" * 220
    assert details["no_context"] == "no_context 1 of 4: 5"
    assert details["group_without_context,genotype_across_contexts"] == "group_without_context reference, treatment; genotype_across_contexts ? and ?"
    assert (details["several_studies"], details["several_organisms"], details["no_axis"]) == ("several_studies S1, S2", "several_organisms A, B", "no_axis 1")


def test_refusals_count_without_expanding(spark):
    assert "Expand" not in plan(registry.QUERIES["contrast_refusals"](spark, "/root/testdata/sf0.001"))


def test_trace_spreads_rows_without_sample(spark):
    assert "_spread" in plan(registry.QUERIES["trace_breaks"](spark, "/root/testdata/sf0.001"))


def test_bounds_are_joined_by_product_alone(spark):
    rows = [("a", 1, ["g"]), ("b", 1, ["g", "x"]), ("c", 1, ["g", "y"]), ("d", 1, []), ("e", 2, ["g"]), ("f", None, ["g"]), ("g", 1, ["u"]), ("h", 1, ["g", None])]
    df = spark.createDataFrame([(i, "yield", 0.5, "g/g", "consumed", p, s) for i, p, s in rows], "id string, kind string, value double, unit string, basis string, product int, substrates array<string>")
    c = spark.createDataFrame([(1, "g", 0.4, True), (1, "x", 0.4, True), (1, "y", 0.3, True), (1, "u", 0.4, False)], "product int, substrate string, g_per_g double, usable boolean")
    out = E.bound_check(df, c, "id")
    assert {r.id for r in out.collect() if r.verdict == "flag"} == {"a", "b"}
    assert plan(out).count("Join") == 1


def test_normal_form_takes_rows_not_arrow_batches(spark):
    assert "BatchEvalPython" in plan(registry.QUERIES["normalize_text"](spark, "/root/testdata/sf0.001"))


def test_ranks_of_counted_values(spark):
    rows = [(0, v, 1) for v in (3.0, 1.0, 3.0, 8.0, -2.0)] + [(1, 5.0, 2)]
    got = S.average_ranks(spark.createDataFrame(rows, "g int, v double, w int"), ["g"], "v", "r", "w").collect()
    assert {tuple(r) for r in got} == {(0, -2.0, 1.0), (0, 1.0, 2.0), (0, 3.0, 3.5), (0, 8.0, 5.0), (1, 5.0, 1.5)}


def test_parsed_rows_are_spread(spark):
    for name in ("construct_genes", "genotype_parts"):
        assert "RepartitionByExpression" in plan(registry.QUERIES[name](spark, "/root/testdata/sf0.001"))


def test_entries_are_read_once_a_text(spark):
    assert "_parts" in plan(registry.QUERIES["literature_recall"](spark, "/root/testdata/sf0.001"))


def test_pointers_at_one_row_or_none_are_spread(spark):
    citable = spark.createDataFrame([("strain", 1), ("strain", 2)], "kind string, id long")
    end = "CASE WHEN id % 2 = 0 THEN {} END"
    pointers = spark.range(8000).selectExpr("id AS n", f"{end.format(chr(39) + 'strain' + chr(39))} AS kind", f"{end.format('CASE WHEN id < 7000 THEN 1L ELSE 9L END')} AS id")
    own = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        out = P._resolved(pointers, citable, "n")
        rows = out.selectExpr("n", "present", "spark_partition_id() AS part").collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert {r.n for r in rows if r.present} == set(range(0, 7000, 2)) and len(rows) == 8000
    sizes = [sum(r.part == k for r in rows) for k in {r.part for r in rows}]
    assert len(sizes) == 4 and max(sizes) < 3000


def test_postings_are_made_without_shuffling_words(spark):
    rows = [("strain", 1, "Alpha beta", "beta ALPHA beta-2", 2000, 0.5), ("strain", 2, None, "x", None, None), ("paper", 1, "", None, 1, 1.0), ("paper", 2, "b", "", 1, 1.0)]
    entities = spark.createDataFrame(rows, "kind string, id long, name string, body string, year int, evidence double")
    entries = L._entries(entities)
    assert "Aggregate" not in plan(entries) and "Repartition" not in plan(entries)
    got = {(r.kind, r.id, r.term): (r.len, r.name, r.body) for r in entries.collect()}
    assert got == {("strain", 1, "alpha"): (6, [0], [1]), ("strain", 1, "beta"): (6, [1], [0, 2]), ("strain", 1, "2"): (6, [], [3]), ("strain", 2, "x"): (1, [], [0]), ("paper", 2, "b"): (1, [0], [])}
    firsts = [(r.kind, r.id) for r in entries.where("first").collect()]
    assert sorted(firsts) == [("paper", 2), ("strain", 1), ("strain", 2)]
    assert L._entries(entities.limit(0)).count() == 0


def test_postings_of_a_term_share_rows(spark, tmp_path):
    rows = [(f"k{i % 2}", i, "Alpha" if i % 5 == 0 else None, "beta alpha beta" if i % 3 else None, 2000 + i, i / 2) for i in range(400)]
    entities = spark.createDataFrame(rows, "kind string, id long, name string, body string, year int, evidence double")
    L.build_index(entities, str(tmp_path), "s")
    blocks = spark.read.parquet(f"{L.current_version(spark, str(tmp_path))}/postings")
    assert blocks.count() == 4  # alpha and beta, two kinds
    texts = {(k, i): [(n or "").lower().split(), (b or "").split()] for k, i, n, b, *_ in rows}
    want = {(*key, w): (len(n) + len(b), [j for j, x in enumerate(n) if x == w], [j for j, x in enumerate(b) if x == w]) for key, (n, b) in texts.items() for w in {*n, *b}}
    assert {(r.kind, r.id, r.term): (r.len, r.name, r.body) for r in L._flat(blocks).collect()} == want
    assert all((r.year, r.evidence) == (2000 + r.id, r.id / 2) for r in L._flat(blocks).collect())
    assert {r.id for r in L.bm25(spark, str(tmp_path), [["beta alpha"]]).collect()} == {i for i in range(400) if i % 3}
