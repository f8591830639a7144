"""Conservation, redox balance, provenance and recall: every kind of failure once."""

from __future__ import annotations

import pytest

from quillon.operators import balance as B
from quillon.operators import graph as G
from quillon.operators import provenance as P
from quillon.operators import recall as R

METABOLITES = [("glc", "Glc", 6, None, None, None), ("pyr", "Pyr", 3, None, None, None), ("nadh", "NADH", 21, "nad", "reduced", None), ("nad", "NAD", 21, "nad", "oxidized", None), ("nadph", "NADPH", 21, "nadp", "reduced", None), ("nadp", "NADP", 21, "nadp", "oxidized", None), ("atp", "ATP", 10, None, None, "charged"), ("adp", "ADP", 10, None, None, "discharged"), ("fadh", "FADH", 27, "fad", "reduced", None)]


@pytest.fixture(scope="module")
def metabolites(spark):
    return spark.createDataFrame(METABOLITES, "metabolite_id string, name string, carbons int, pair string, redox string, adenylate string")


def sides(spark, **reactions):
    rows = [(r, m, role, float(k)) for r, (left, right) in reactions.items() for role, side in (("substrate", left), ("product", right)) for m, k in side.items()]
    return spark.createDataFrame(rows, "reaction_id string, metabolite_id string, role string, coefficient double")


def test_every_way_not_to_conserve(spark, metabolites):
    parts = sides(
        spark,
        good=({"glc": 1, "nad": 2, "atp": 1}, {"pyr": 2, "nadh": 2, "adp": 1}), carbon=({"glc": 1}, {"pyr": 1}), pool=({"nadh": 1}, {"nadp": 1}), lost=({"pyr": 7, "nadh": 1}, {"pyr": 14}),
        charge=({"atp": 1}, {"atp": 1}), stranger=({"xyz": 1}, {"pyr": 1}), kinase=({"nadh": 1, "atp": 1}, {"nadph": 1, "adp": 1}), typo=({"nadh": 1, "atp": 1}, {"nadph": 2, "adp": 1}),
    )
    reactions = spark.createDataFrame([(r, r in ("kinase", "typo")) for r in ("good", "carbon", "pool", "lost", "charge", "stranger", "kinase", "typo", "empty")], "reaction_id string, transfers boolean")
    got = {r.reaction_id: r.problems for r in B.conservation(parts, metabolites, reactions).collect()}
    assert got == {
        "good": [], "carbon": ["carbon"], "pool": ["nad redox", "nadp redox"], "lost": ["nad redox", "redox carriers"], "charge": ["adenylate"], "stranger": ["undeclared", "carbon"], "kinase": [],
        "typo": ["carbon", "redox carriers"], "empty": [],
    }


def redox(spark, metabolites, steps, reactions, parts):
    s = spark.createDataFrame([(r, "p", role, f"part{role}", where, cof, genes) for r, role, where, cof, genes in steps], "route_id string, pathway_id string, step_role int, part_id string, compartment string, cofactor string, genes array<string>")
    rs = spark.createDataFrame([(r, "p", role, genes, t) for r, role, genes, t in reactions], "reaction_id string, pathway_id string, step_role int, genes array<string>, transfers boolean")
    return {r.route_id: r for r in B.redox_balance(s, rs, parts, metabolites).collect()}


def test_redox_balance_of_routes(spark, metabolites):
    parts = sides(spark, spend=({"nadh": 1, "pyr": 1}, {"nad": 1, "pyr": 1}), make=({"nad": 1}, {"nadh": 1}), none=({"glc": 1}, {"pyr": 2}), kinase=({"nadh": 1}, {"nadph": 1}), typo=({"nadh": 1}, {"nadph": 2}), both=({"nadh": 1, "nadph": 1}, {"nad": 1, "nadp": 1}), flavin=({"fadh": 1}, {"pyr": 1}), spend2=({"nadph": 2}, {"nadp": 2}))
    parts = parts.union(spark.createDataFrame([("loose", "nadh", "cofactor", 1.0)], parts.schema))
    reactions = [("spend", 0, ["KARI"], False), ("none", 1, [], False), ("make", 2, ["ADH3"], False), ("kinase", 3, ["POS5"], True), ("typo", 4, [], True), ("both", 5, [], False), ("flavin", 6, [], False), ("loose", 7, [], False), ("spend", 8, ["ADH1"], False), ("spend2", 8, ["ADH6"], False)]
    cyt, mat = "cytosol", "matrix"
    steps = [("open", 0, cyt, "NADH", []), ("open", 2, mat, "NADH", []), ("closed", 0, mat, "NADH", []), ("closed", 1, mat, "NA", []), ("closed", 2, mat, "NADH", []), ("moved", 3, mat, "unknown", []), ("swapped", 0, mat, "NADPH", [])]
    steps += [("gene", 8, cyt, "NADPH", ["adh6"]), ("genes", 8, cyt, "NADPH", ["adh1", "adh6"])]
    steps += [(f"u{role}{cof}", role, cyt, cof, []) for role, cof in [(9, "NADH"), (4, "NADH"), (5, "NADH"), (6, "NADH"), (7, "NADH"), (0, "either"), (0, "NA"), (1, "NADH")]]
    got = redox(spark, metabolites, steps, reactions, parts)
    buckets = {k: [tuple(b) for b in r.open_buckets] for k, r in got.items()}
    assert got["open"].status == "unbalanced" and buckets["open"] == [(cyt, "NADH", -1.0), (mat, "NADH", 1.0)]  # never across a membrane
    assert got["closed"].status == "balanced" and not buckets["closed"]
    assert got["moved"].status == "unbalanced" and sum(b[2] for b in buckets["moved"]) == 0  # a transfer conserves
    assert buckets["swapped"] == [(mat, "NADPH", -1.0)] and [s.change for s in got["swapped"].substitutions] == ["NADH to NADPH"]
    assert buckets["gene"] == [(cyt, "NADPH", -2.0)] and [u.reason for u in got["genes"].unknowns] == ["reactions disagree"]
    reasons = {k: [u.reason for u in r.unknowns] for k, r in got.items() if k[0] == "u"}
    assert reasons == {"u9NADH": ["no reaction"], "u4NADH": ["transfer does not conserve"], "u5NADH": ["two pools"], "u6NADH": ["pool without a name"], "u7NADH": ["no direction"], "u0either": ["pool not recorded"], "u0NA": ["part and pathway disagree"], "u1NADH": ["amount not recorded"]}
    assert all(got[k].status == "unknown" for k in reasons)


def test_risks_lower_the_balance_score(spark):
    parts = spark.createDataFrame([(1, 0, "NADPH"), (2, 1, "either"), (3, 1, "NADPH")], "part_id long, step_role int, cofactor string")
    plan = spark.createDataFrame([("A", 0, "matrix", "mitochondrial", 1.0), ("A", 1, "cytosol", "nuclear", 1.0)], "strategy string, role int, compartment string, encoding string, feasibility double")
    none = spark.createDataFrame([], "source string, target string")
    pools = {"cytosol": ["NADH", "NADPH"], "matrix": ["NADH"]}
    r = G.enumerate_routes(parts, plan, [0, 1], 5, [(0, 1)], none, pools).collect()
    assert {x.route_id: (x.balance_score, x.transport_score, x.risks) for x in r} == {f"A:1+{p}": (0.5, 0.5, ["role 0: NADPH in matrix"]) for p in (2, 3)}
    assert {x.balance_score for x in G.enumerate_routes(parts, plan, [0, 1], 5, [], none).collect()} == {None}  # not looked at


def test_every_break_and_gap(spark):
    rows = [("publication", 1, None, None, None), ("publication", 2, None, None, None), ("span", 1, 1, None, None), ("span", 2, None, None, None), ("span", 3, 99, None, None), ("extraction", 1, 2, None, None), ("analysis_result", 1, None, 1, 1), ("analysis_result", 2, None, 7, 9), ("analysis_result", 3, None, 1, None), ("processing_run", 1, None, None, None), ("dataset", 1, None, None, None), ("strain", 1, None, None, None)]
    citable = spark.createDataFrame(rows, "kind string, id long, publication_id long, processing_run_id long, dataset_id long")
    columns = ["publication_id", "span_id", "extraction_id", "measurement_id", "analysis_result_id", "processing_run_id", "strain_id"]
    cases = {
        "paper": ({"publication_id": 1}, ["literature"], [], []), "span": ({"span_id": 1}, ["literature"], [], []), "lost paper": ({"publication_id": 5}, [], [("dangling_citation", "publication_id")], []),
        "wrong span": ({"publication_id": 2, "span_id": 1}, ["literature"], [("span_publication_mismatch", "span_id")], []), "wrong extraction": ({"publication_id": 1, "extraction_id": 1}, ["literature"], [("extraction_publication_mismatch", "extraction_id")], []),
        "span of none": ({"span_id": 2}, [], [("dangling_citation", "span to publication")], []), "span of a lost one": ({"span_id": 3}, [], [("dangling_citation", "span to publication")], []),
        "deposit": ({"analysis_result_id": 1}, ["analysis"], [], []), "no run": ({"analysis_result_id": 2}, [], [("dangling_citation", "analysis_result to processing_run"), ("dangling_citation", "analysis_result to dataset")], []),
        "no deposit": ({"analysis_result_id": 3}, ["analysis"], [], ["dataset_unreachable"]), "run alone": ({"processing_run_id": 1}, ["analysis"], [], ["dataset_unreachable"]),
        "strain alone": ({"strain_id": 1}, [], [("evidence_cites_nothing", "evidence")], []), "nothing": ({}, [], [("evidence_cites_nothing", "evidence")], []),
    }
    evidence = spark.createDataFrame([(1, name, "active", *(cites.get(c) for c in columns)) for name, (cites, *_) in cases.items()], "assertion_id long, evidence_id string, status string, " + ", ".join(f"{c} long" for c in columns))
    got = {r.evidence_id: (r.arms, [tuple(b) for b in r.breaks], r.gaps) for r in P.walk_evidence(evidence, citable).collect()}
    assert got == {name: tuple(rest) for name, (_, *rest) in cases.items()}
    said = [(1, "active", "strain", 1, "literal", None), (2, "active", "strain", 8, "run", None), (3, "active", "gadget", 1, "run", 1), (4, "retired", "strain", 1, "literal", None)]
    statements = spark.createDataFrame(said, "assertion_id long, status string, subject_type string, subject_id long, object_type string, object_id long")
    curation = spark.createDataFrame([(1, "me"), (1, " "), (3, " "), (3, None)], "target_id long, curator string")
    kinds = {"strain": "strain", "run": "processing_run"}
    rows = {r.assertion_id: r for r in P.walk_assertions(statements, evidence, citable, curation, kinds, kinds).collect()}
    assert set(rows) == {1, 2, 3} and rows[1].n_evidence == len(cases) and rows[1].gaps == 2 and rows[1].evidence_cites_nothing == 2 and not rows[1].no_curation_event
    assert (rows[2].no_evidence, rows[2].dangling_subject, rows[2].dangling_object, rows[2].no_curation_event) == (1, 1, 1, 1)
    assert (rows[3].dangling_subject, rows[3].dangling_object, rows[3].curation_event_unnamed) == (1, 0, 1) and not any(r.complete for r in rows.values())
    good = evidence.where("evidence_id = 'paper'")
    assert P.walk_assertions(statements.where("assertion_id = 1"), good, citable, curation, kinds, kinds).first().complete


def test_names_resolve_or_are_refused(spark):
    catalog = [(1, 0, ["ilvC"], [], "Escherichia coli"), (2, 0, ["ilvC"], ["6e6"], "Escherichia coli"), (3, 0, ["ilvC"], ["p2d1a1"], "Escherichia coli"), (4, 0, ["ilvC"], ["p2d1a1"], "Escherichia coli"), (5, 1, ["ADH1"], [], "Saccharomyces cerevisiae"), (6, 2, ["kivD"], [], "Lactococcus lactis"), (7, 1, ["adhA"], [], "Lactococcus lactis")]
    parts = spark.createDataFrame(catalog, "part_id long, step_role int, genes array<string>, designations array<string>, organism string")
    said = {"bare ilvC": ("gene", 0, [1, 2, 3, 4]), "ilvC 6E6": ("variant", 0, [2]), "ilvC P2D1-A1": ("ambiguous_variant", 0, [3, 4]), "ADH7": ("unrecognised", None, None), "LlAdhA": ("gene", 1, [7]), "KDC from Lactococcus lactis": ("source", 2, [6]), "KDC from L. lactis": ("source", 2, [6]), "KARI from E. coli": ("ambiguous_source", 0, [1, 2, 3, 4]), "ADH from Zymomonas mobilis": ("role_only", None, None), "a KDC": ("role_only", None, None), "KDC and ADH from Lactococcus lactis": ("role_only", None, None), "ILV genes from Lactococcus lactis": ("role_only", None, None)}
    entries = spark.createDataFrame([(i, e) for i, e in enumerate(said)], "config_id long, entry string")
    out = R.resolve_roles(entries, parts, {"lladha": "adhA"}, {"kdc": 2, "kari": 0, "adh": 1}, ["ilv"])
    assert {r.entry: (r.outcome, r.role, r.part_ids) for r in out.collect()} == said


def test_matching_asks_every_role(spark):
    routes = spark.createDataFrame([(i, "A", r, p) for i, ps in enumerate([(1, 2), (1, 3), (4, 2)]) for r, p in enumerate(ps)], "route_id long, strategy string, role int, part_id long")
    wanted = spark.createDataFrame([("x", "A", 0, 1), ("x", "A", 1, 2), ("x", "A", 1, 3), ("y", "A", 0, 4), ("z", "A", 0, 9), ("z", "A", 1, 2), ("w", "B", 0, 1)], "signature string, strategy string, role int, part_id long")
    assert {tuple(r) for r in R.matching_routes(wanted, routes).collect()} == {("x", 2), ("y", 1)}
