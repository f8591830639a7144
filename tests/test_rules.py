"""Rules as operators, on small fixtures and against plain Python."""

from __future__ import annotations

import datetime as dt
import json
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon import tools
from quillon.functions import grammar as G
from quillon.functions import payload as P
from quillon.functions import sections as S
from quillon.functions import sequence as Q
from quillon.functions import text as X
from quillon.operators import evidence as E
from quillon.operators import graph, literature, search
from quillon.operators import queue as QUEUE
from quillon.operators import statistics as STAT
from quillon.sources import files, landed, sinks, store
from quillon.streaming import features, queue


def test_find_all_against_python(spark):
    rng = random.Random(4)
    rows = [("".join(rng.choices("ab.\\EQ", k=rng.randint(0, 30))), "".join(rng.choices("ab.\\EQ", k=rng.randint(0, 3)))) for _ in range(300)] + [("x" * 5000, "xx"), ("\U0001f600a\U0001f600", "a"), (None, "a")]
    df = spark.createDataFrame(rows, "t string, n string")
    for r in df.select("t", "n", X.find_all(F.col("t"), F.col("n")).alias("at")).collect():
        if r.t is not None:
            assert r["at"] == [i for i in range(len(r.t)) if r.n and r.t.startswith(r.n, i)], (r.t, r.n)


def plain_sections(text):
    """Sections by reading lines, without folding."""
    names = [(n, re.compile(p + r"\Z", re.I)) for n, p in S.HEADINGS]
    found, at = [], 0
    for line in text.split("\n"):
        m = re.match(r"[ \t]*(?:#{1,6}[ \t]*)?(?:\d+(?:\.\d+)*[.)]?[ \t]*)?\*{0,2}([A-Za-z].{0,60}?)\*{0,2}[ \t]*:?[ \t]*\Z", line)
        said = re.sub(r"\s+", " ", m[1]).strip().strip(".").lower() if m else ""
        name = next((n for n, p in names if p.match(said)), None) if said else None
        if name:
            found.append((name, at))
        at += len(line) + 1
    if not found:
        return [("unsectioned", 0, len(text))]
    starts = ([("front_matter", 0)] if found[0][1] else []) + found
    return [(n, a, b) for (n, a), b in zip(starts, [a for _, a in starts[1:]] + [len(text)])]


def test_sections_tile_the_text(spark):
    rng = random.Random(2)
    lines = ["Introduction", "2. Methods", "**Results**", "## Results and Discussion:", "References", "Some plain text.", "", "Methods were used", "3.1) Materials and methods", "x" * 130, "Abstract.", "Conclusions"]
    texts = ["\n".join(rng.choices(lines, k=rng.randint(1, 12))) for _ in range(150)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", S.split_sections(F.col("t")).alias("s"))
    for r in df.collect():
        got, want = [tuple(x)[:3] for x in r.s], plain_sections(r.t)
        assert got[0][1] == 0 and got[-1][2] == len(r.t) and all(a[2] == b[1] for a, b in zip(got, got[1:]))
        if got != want:  # a structured abstract was folded
            k = next(i for i, (a, b) in enumerate(zip(got, want)) if a != b)
            end = got[k][2]
            parts = [w for w in want if got[k][1] <= w[1] < end]
            names = [w[0] for w in parts]
            opener = next(n for n in names if n in S.BODY_OPENERS)
            assert got[k][0] == "abstract" and len(set(names)) == len(names) and opener in [w[0] for w in want if w[1] >= end]


def test_excerpts_lead_back(spark):
    text = "Front\nMethods\nwe did\nResults\nit was 5 g/L\nReferences\nnone"
    df = spark.createDataFrame([(text,)], "t string").withColumn("s", S.split_sections(F.col("t")))
    e = df.select("t", S.excerpt(F.col("t"), F.col("s"), ["methods", "results"]).alias("e")).select("t", "e.*")
    r = e.select("text", "pieces", S.to_document(F.col("pieces"), F.locate("5 g/L", F.col("text")) - 1, F.locate("5 g/L", F.col("text")) + 4).alias("d"), S.to_document(F.col("pieces"), F.lit(0), F.lit(40)).alias("across")).first()
    assert text[r.d.start : r.d.end] == "5 g/L" and r.across is None
    assert all(text[p.doc_start : p.doc_end] == r.text[p.exc_start : p.exc_end] for p in r.pieces)
    body = "para one.\n\n" * 40
    w = spark.createDataFrame([(body,)], "t string").select(S.windows(F.col("t"), 100, 20).alias("w")).first().w
    assert w[0].start == 0 and w[-1].end == len(body) and all(0 < x.end - x.start <= 100 for x in w)
    assert all(b.start <= a.end for a, b in zip(w, w[1:]))
    with pytest.raises(ValueError):
        S.windows(F.col("t"), 10, 10)


def test_genotypes(spark):
    df = spark.createDataFrame([("BY4741 lpd1\u0394/pAB-x-y; \u2206ilv2; odd thing; \u0394a(b;(c))",)], "g string").select(G.parse_genotype(F.col("g")).alias("p"))
    p = df.select("p", G.deletions(F.col("p")).alias("d")).first()
    assert [(x.kind, x.target) for x in p.p] == [("background", "BY4741"), ("deletion", "lpd1"), ("plasmid", "pAB"), ("deletion", "ilv2"), ("unparsed", None), ("deletion", "a")]
    assert p.d == ["LPD1", "ILV2", "A"] and p.p[2].carries == ["x", "y"] and p.p[5].detail == "b;(c)"


def test_phases(spark):
    segments = [(0, 10, 1, 1), (20, 25, 1, 2), (30, 34, 1, 0)]
    df = spark.createDataFrame([([dict(zip(("start", "end", "strand", "phase"), s)) for s in segments],)], "s array<struct<start:long,end:long,strand:int,phase:int>>")
    r = df.select(Q.expected_phases(F.col("s")).alias("e"), Q.phase_disagreement(F.col("s")).alias("d")).first()
    assert [x.expected for x in r.e] == [1, 0, 1] and r.d.start == 20
    rows = spark.createDataFrame([("m", *s) for s in segments], "m string, start long, end long, strand int, phase int")
    assert [x.expected_phase for x in files.running_phase(rows, "m").orderBy("start").collect()] == [1, 0, 1]


def test_comparability(spark):
    df = spark.createDataFrame([("a", "b", "c"), (None, "b", "c"), ("a", "NA", None), ("a", "b", "unknown")], "x string, y string, z string")
    key, standing = E.comparability_class(["x", "y"], ["z"])
    assert [tuple(r) for r in df.select(key, standing).collect()] == [
        ("x=a|y=b|z=c", "classified"), ("unclassified|x=?|y=b|z=c", "unclassified"), ("unclassified|x=a|y=?|z=?", "unclassified"), ("x=a|y=b|z=?", "provisional"),
    ]


def test_bounds(spark):
    c = spark.createDataFrame([("p", "g", 0.4, True), ("p", "x", 0.4, True), ("p", "y", 0.3, True), ("p", "u", 0.4, False)], "product string, substrate string, g_per_g double, usable boolean")
    rows = [(1, "yield", 0.41, "g/g", "c", "p", ["g"]), (2, "yield", 0.4, "g/g", "c", "p", ["g", "x"]), (3, "yield", 0.1, "g/g", "c", "p", ["g", "y"]), (4, "yield", 0.1, "g/g", "c", "p", ["u"]), (5, "yield", 0.1, "g/g", None, "p", ["g"]),
            (6, "titer", 5.0, "g/L", "c", "p", ["g"]), (7, "yield", 1.2, "x", "fraction_of_theoretical", None, []), (8, "yield", 0.1, "g/g", "c", None, ["g"]), (9, "yield", 0.1, "g/g", "c", "p", None)]
    df = spark.createDataFrame(rows, "id int, kind string, value double, unit string, basis string, product string, substrates array<string>")
    got = {r.id: r.verdict for r in E.bound_check(df, c, "id").collect()}
    assert got == {1: "flag", 2: "pass", 3: "not_evaluable", 4: "not_evaluable", 5: "refused", 6: "not_evaluable", 7: "flag", 8: "not_evaluable", 9: "not_evaluable"}


def test_steps(spark):
    rows = [("a", "c1", 2.0, 0.01), ("a", "c2", -2.0, 0.01), ("b", "c1", 2.0, 0.01), ("b", "c2", 0.1, 0.9), ("c", "c1", 3.0, None), ("d", "c1", 0.2, 0.5), ("e", None, None, None), ("f", "c1", 9.0, 0.001)]
    df = spark.createDataFrame(rows, "s string, c string, l double, p double")
    got = {r.s: (r.verdict, r.agreeing) for r in E.step_verdicts(df, "s", "c", "l", "p", F.col("s") == "f").collect()}
    assert got == {"a": ("inconsistent_across_contrasts", 0), "b": ("elevated_in_build", 1), "c": ("elevated_not_resolved", 0), "d": ("unchanged_in_build", 0), "e": ("no_contrast", 0), "f": ("confounded_by_construct", 1)}


def test_moderated_t(spark):
    df = spark.createDataFrame([(1.0, 2.0), (0.0, 1.0)], "v double, d double")
    far = STAT.moderated_t(df, "v", "d", 4.0, (2.0, float("inf")), 3, 3).collect()
    assert all(r.df == 1e6 for r in far) and far[0].t == pytest.approx(2 / (2 * 2 / 3) ** 0.5)
    none = STAT.moderated_t(df, "v", "d", 4.0, (2.0, 0.0), 3, 3).collect()
    assert none[0].t == pytest.approx(2 / (2 / 3) ** 0.5) and none[1].t is None and none[1].p is None
    some = STAT.moderated_t(df, "v", "d", 4.0, (2.0, 4.0), 3, 3).first()
    assert some.df == 8 and some.t == pytest.approx(2 / (1.5 * 2 / 3) ** 0.5)


# ---------------------------------------------------------------- payloads


JSON = st.recursive(st.none() | st.booleans() | st.integers(-5, 5) | st.text("ab", max_size=3), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text("kxy", min_size=1, max_size=2), x, max_size=4), max_leaves=12)


@settings(max_examples=80, deadline=None)
@given(JSON)
def test_leaves_and_budget(value):
    assert len(dict(P.leaves(value))) == len(list(P.leaves(value)))
    out, cuts = P.trim({"data": value, "contract": ["c"] * 50, "rows": ["r" * 20] * 60}, 600)
    assert P.characters(out) <= 600 or not list(P._places(out))
    assert all(kept < held for held, kept in cuts.values())


def test_budget_cuts_the_contract_last():
    out, cuts = P.trim({"data": ["x" * 10] * 60, "contract": ["y" * 10] * 60}, 1200)
    assert set(cuts) == {"data"} and cuts["data"][0] == 60 and len(out["contract"]) == 60
    out, cuts = P.trim({"data": ["x"], "contract": ["y" * 10] * 200}, 700)
    assert set(cuts) == {"contract"} and out["data"] == ["x"]


def test_schema():
    schema = {"type": "object", "properties": {"n": {"type": ["number", "null"], "exclusiveMinimum": 0}, "k": {"enum": ["a", 1]}, "s": {"pattern": "^x", "maxLength": 3}, "l": {"minItems": 1, "items": {"oneOf": [{"type": "string"}, {"const": 2}]}}}, "additionalProperties": False}
    assert P.check({"n": 1.5, "k": "a", "s": "xy", "l": ["a", 2]}, schema) == []
    assert len(P.check({"n": 0, "k": True, "s": "yyyy", "l": [], "z": 1}, schema)) == 6
    assert P.check({"n": None, "l": [3]}, schema) == ["$.l[0]: doesn't fit exactly one of oneOf"]
    with pytest.raises(ValueError, match="ref"):
        P.supported({"properties": {"a": {"$ref": "#/x"}}})


# ---------------------------------------------------------------- queue and literature


def test_queue_refusals(spark):
    t = dt.datetime(2020, 1, 1)
    tasks = spark.createDataFrame([(1, "in_progress", 1, t, t, "w", "me", 1), (2, "pending", 1, t, None, None, "me", 0), (3, "accepted", 1, t, None, None, "x", 0)], "task_id int, status string, priority int, created_at timestamp_ntz, lease_expires_at timestamp_ntz, claimed_by string, proposed_by string, attempts int")
    beats = spark.createDataFrame([(1, "other"), (9, "w"), (2, "w")], "task_id int, worker_id string")
    assert {tuple(r) for r in QUEUE.heartbeat(tasks, beats, F.lit(t), 60)[1].collect()} == {(1, "other", "lease_lost"), (9, "w", "no_such_task"), (2, "w", "lease_lost")}
    v = [(1, "accept", "c", "human", "ok", None, t), (1, "reject", "d", "human", "no", None, t + dt.timedelta(1)), (2, "accept", "me", "human", "ok", None, t), (3, "reject", "c", "human", "no", None, t), (4, "reject", "c", "human", "no", None, t), (2, "edit", "c", "human", "ok", "", t), (2, "shrug", "c", "human", "ok", None, t)]
    verdicts = spark.createDataFrame(v, "task_id int, action string, curator string, curator_kind string, reason string, edited_payload string, decided_at timestamp_ntz")
    after, refused = QUEUE.decide(tasks, verdicts)
    assert {r.task_id: r.status for r in after.collect()} == {1: "accepted", 2: "pending", 3: "accepted"}
    assert sorted((r.task_id, r.refusal) for r in refused.collect()) == [(1, "already_resolved"), (2, "no_payload"), (2, "no_such_action"), (2, "self_review"), (3, "already_resolved"), (4, "no_such_task")]


def test_contexts_are_all_or_nothing(spark):
    vocabulary = spark.createDataFrame([("a", True)], "facet string, has_column boolean")
    good, bad = [("x", {"a": "1"})], [("y", {"a": "1", "z": "2"}), ("e", {})]
    frame = lambda rows: spark.createDataFrame(rows, "label string, facets map<string,string>")
    assert QUEUE.write_contexts(frame(good), vocabulary, "me", "human", "read")[0].count() == 1
    rows, refused = QUEUE.write_contexts(frame(good + bad), vocabulary, "me", "human", "read")
    assert rows.count() == 0 and {r.label for r in refused.collect()} == {"y", "e"}
    with pytest.raises(ValueError):
        QUEUE.write_contexts(frame(good), vocabulary, " ", "human", "read")


def test_ambiguous_files(spark):
    papers = spark.createDataFrame([(1, "d1", "s", "alpha beta gamma delta"), (2, "d2", "s", "alpha beta")], "paper int, doi string, slug string, title string")
    names = [("a", "D1", None, "gamma delta alpha beta"), ("b", None, "s", ""), ("c", "d1", None, "nothing of it"), ("d", None, None, "x"), ("e", "d2", None, "no check with two words")]
    df = spark.createDataFrame(names, "file string, doi string, slug string, opening string")
    assert {r.file: r.verdict for r in literature.match_files(df, papers, ["doi", "slug"]).collect()} == {"a": "stored", "b": "ambiguous", "c": "title_mismatch", "d": "unmatched", "e": "stored"}


# ---------------------------------------------------------------- search and routes


def test_index(spark, tmp_path):
    rows = [("p", 1, "Blue Yeast", "yeast makes isobutanol fast", 2020, 1.0), ("p", 2, "Other", "iso butanol and yeast. yeast", 1990, 0.0), ("s", 3, "yeast", "", None, None), ("s", 4, "", "nothing here", 2000, 0.5)]
    df = spark.createDataFrame(rows, "kind string, id long, name string, body string, year int, evidence double")
    path = f"file://{tmp_path}/index"
    assert search.ensure_index(spark, df, path, "one") == "missing"
    assert search.ensure_index(spark, df, path, "one") == "fresh" and search.index_status(spark, path, "two") == "stale"
    found = lambda *w, **k: [r.id for r in search.search(spark, path, w, **k).collect()]
    assert set(found("yeast")) == {1, 2, 3} and found("yeast", "isobutanol") == [1]
    assert found("isobutanol", synonyms={"isobutanol": ["iso butanol"]}) == [1, 2]
    assert found("yeast", kinds=["s"]) == [3] and found("butanol iso") == [] and len(found("yeast", limit=2)) == 2
    pairs = search.synonyms(spark.createDataFrame([(1, "A"), (1, "b"), (2, "c")], "e int, n string"), "e", "n")
    assert search.dictionary(pairs, ["a", "c"]) == {"a": ["b"], "c": []}


def test_routes_need_every_role(spark):
    parts = spark.createDataFrame([(1, 0), (2, 1)], "part_id int, step_role int")
    plan = spark.createDataFrame([("A", r, "cytosol", "nuclear", 1.0) for r in range(3)], "strategy string, role int, compartment string, encoding string, feasibility double")
    none = spark.createDataFrame([], "source string, target string")
    with pytest.raises(ValueError, match="role 2"):
        graph.enumerate_routes(parts, plan, [0, 1, 2], 5, [], none)
    assert [r.route_id for r in graph.enumerate_routes(parts, plan, [0, 1], 5, [(0, 1)], none).collect()] == ["A:1+2"]
    assert graph.power_set(parts.limit(0), "part_id").collect()[0].size == 0
    many = graph.power_set(spark.range(21), "id")
    assert many.count() == 1 << 21
    with pytest.raises(ValueError):
        graph.power_set(spark.range(70), "id")


# ---------------------------------------------------------------- sources and sinks


def test_store(spark, tmp_path):
    path, schemas = f"file://{tmp_path}/store", {"a": "id int, v string"}
    assert store.schema_version(spark, path) is None
    store.create_schema(spark, path, schemas, 1)
    with pytest.raises(ValueError):
        store.create_schema(spark, path, schemas, 1)
    spark.createDataFrame([(1, "x")], schemas["a"]).write.mode("append").parquet(f"{path}/a")
    assert store.open_store(spark, path, schemas, 1)["a"].count() == 1
    steps = [(2, "a", lambda df: df.withColumn("w", F.upper("v"))), (3, "a", lambda df: df.drop("v"))]
    assert store.migrate(spark, path, steps, 3) == [2, 3]
    with pytest.raises(ValueError):
        store.open_store(spark, path, schemas, 1)
    assert [tuple(r) for r in store.open_store(spark, path, {"a": "id int, w string"}, 3)["a"].collect()] == [(1, "X")]
    assert spark.read.parquet(f"{path}/_backup-a-1").columns == ["id", "v"]
    with pytest.raises(ValueError, match="chain"):
        store.pending(1, steps, 4)


def test_yaml_and_fixtures(spark, tmp_path):
    (tmp_path / "doc.yaml").write_text("version: 1\nfamilies:\n- {id: a, n: 2}\n- {id: b}\n")
    df = store.read_yaml(spark, str(tmp_path / "doc.yaml"), "id string, n int", "families", {"type": "object", "required": ["id"]})
    assert [tuple(r) for r in df.orderBy("id").collect()] == [("a", 2), ("b", None)]
    with pytest.raises(ValueError, match="row 1: \\$: n is required"):
        store.read_yaml(spark, str(tmp_path / "doc.yaml"), "id string", "families", {"required": ["n"]})
    (tmp_path / "t.yaml").write_text("- {id: 1}\n")
    tables = store.load_fixture(spark, str(tmp_path), {"t": "id int, v string", "u": "id int"}, ["t", "u"])
    assert [tuple(r) for r in tables["t"].collect()] == [(1, None)] and tables["u"].count() == 0
    (tmp_path / "t.yaml").write_text("- {id: 1, odd: 2}\n")
    with pytest.raises(ValueError, match="odd"):
        store.load_fixture(spark, str(tmp_path), {"t": "id int"}, ["t"])


def test_paths():
    assert store.portable_path("C:\\data\\x\\y.txt").endswith("data/x/y.txt") and store.portable_path("/a/b/c", "/a") == "b/c"
    there = {"/new/raw/x.txt", "/kept"}
    assert store.resolve_stored_path("D:\\old\\raw\\x.txt", "/new", there.__contains__) == "/new/raw/x.txt"
    assert store.resolve_stored_path("/kept", "/new", there.__contains__) == "/kept"
    assert store.resolve_stored_path("/gone/z.txt", "/new", there.__contains__) == "/new/z.txt"


def test_locations(spark):
    cases = {"5..9": (4, 9, 1, 1), "complement(join(<1..3,7..>10))": (0, 10, -1, 2), "join(J00194.1:100..202,1..245)": (0, 245, 1, 2), "102": (101, 102, 1, 1)}
    df = spark.createDataFrame([(k,) for k in cases], "l string")
    for r in df.select("l", files.location(F.col("l")).alias("p")).collect():
        assert (r.p.start, r.p.end, r.p.strand, len(r.p.segments)) == cases[r.l]


def test_landed(spark):
    assert [tuple(r) for r in landed.pages(spark, 450, 200).collect()] == [(0, 200), (200, 200), (400, 50)]
    tried = landed.fetch(landed.pages(spark, 3, 1), lambda row: json.dumps({"esearchresult": {"retstart": str(row["retstart"]), "idlist": ["7", str(row["retstart"])]}}))
    assert {r.id: r.place for r in landed.search_ids(tried).collect()} == {"7": 0, "0": 1, "1": 2, "2": 3}

    def down(row):
        raise OSError("no route")

    assert {r.error for r in landed.fetch(landed.pages(spark, 2, 1), down).collect()} == {"no route"}
    flat = spark.createDataFrame([("ENTRY       R1  Reaction\nNAME        one;\n            two\n///\nENTRY       R2\n///\n",)], "body string")
    assert {tuple(r) for r in landed.flat_entries(flat).collect()} >= {("R1", "NAME", "one;"), ("R1", "NAME", "two"), ("R2", "ENTRY", "R2")}
    entry = spark.createDataFrame([(json.dumps({"primaryAccession": "P1", "organism": {"scientificName": "S"}, "sequence": {"length": 9}}),)], "body string")
    assert tuple(landed.protein_entries(entry).first())[:4] == ("P1", None, "S", 9)


def test_documents_for_readers(spark):
    f = spark.createDataFrame([("b.json", 2, "d", "rows"), ("a.json", 1, "c", "more")], "path string, rows int, digest string, description string")
    graph_ = json.loads(sinks.crate(f, "release", "2026-01-01", "CC-BY-4.0"))["@graph"]
    assert graph_[1]["hasPart"] == [{"@id": "a.json"}, {"@id": "b.json"}] and len(graph_) == 4
    page = sinks.review_page(spark.createDataFrame([("<b>&", 1), (None, 2)], "t string, n int"), "x < y", most=1)
    assert "&lt;b&gt;&amp;" in page and "there are more" in page and "</script><" not in page.split('id="rows">')[1].split("</script>")[0]
    assert "- t: ä" in sinks.proposals(spark.createDataFrame([("ä",)], "t string"), {"version": 1})


# ---------------------------------------------------------------- streams and tools


def test_streaming_twins(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(t0, "a", "x"), (t0 + dt.timedelta(minutes=1), "a", "x"), (t0 + dt.timedelta(minutes=20), "b", "y"), (t0 + dt.timedelta(hours=3), "b", "z")]
    spark.createDataFrame(rows, "ts timestamp, kind string, k string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("ts timestamp, kind string, k string").parquet(str(tmp_path / "in"))
    for name, df in (("once", queue.idempotent(stream(), ["k"], "ts")), ("counts", queue.activity(stream(), "ts", "kind"))):
        df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.k for r in spark.table("once").collect()) == ["x", "y", "z"]
    assert {(r.kind, r.n) for r in spark.table("counts").collect()} == {("a", 2), ("b", 1)}


def test_genes_are_flushed_by_position(spark, tmp_path):
    rows = [("c", 1, "g1", 0, 50), ("c", 2, "g1", 10, 90), ("c", 3, "g2", 100, 150), ("c", 4, "g3", 900, 950)]
    schema = "seqid string, line long, owner string, start long, end long"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    out = features.flush_genes(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 200)
    out.writeStream.format("memory").queryName("genes").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert {tuple(r) for r in spark.table("genes").collect()} == {("c", "g1", 0, 90, 2), ("c", "g2", 100, 150, 1)}


def test_shuffled_lines_give_the_ordered_answer(spark, tmp_path):
    """Lines of two sequences, dealt to files out of order by up to 8 numbers: every gene once, as in order."""
    rng = random.Random(4)
    rows, want, line = [], set(), 0
    for seq in ("a", "b"):
        for g in range(30):
            parts = [(g * 1000 + i * 10, g * 1000 + i * 10 + 5) for i in range(rng.randint(1, 4))]
            rows += [(seq, line + i, f"{seq}{g}", *p) for i, p in enumerate(parts)]
            line += len(parts)
            want.add((seq, f"{seq}{g}", parts[0][0], parts[-1][1], len(parts)))
        rows.append((seq, line, None, None, None))  # closes all before it
        line += 1
        rows += [(seq, line + 20 + i, f"{seq} end", 90_000, 90_001) for i in range(1)]  # so that the last lines ripen
        line += 21
    schema = "seqid string, line long, owner string, start long, end long"
    rows.sort(key=lambda r: r[1] + rng.random() * 8)
    for i in range(0, len(rows), 25):
        part = rows[i : i + 25]
        rng.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    features.flush_genes(stream, 200, late=35).writeStream.format("memory").queryName("shuffled").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = [tuple(r) for r in spark.table("shuffled").collect()]
    assert len(got) == len(set(got)) and set(got) <= want and len(want - set(got)) <= 2 * 10
    features.flush_genes(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 200).writeStream.format("memory").queryName("together").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert {tuple(r) for r in spark.table("together").collect()} == want


def test_line_service(spark):
    tools_ = {"add": lambda a: a["x"] + a["y"]}
    lines = ['{"jsonrpc":"2.0","id":1,"method":"tools/call","params":{"name":"add","arguments":{"x":1,"y":2}}}', '{"id":2,"method":"tools/list"}', "nonsense", '{"method":"note"}', '{"id":3,"method":"tools/call","params":{"name":"gone"}}', '{"id":4,"method":"tools/call","params":{"name":"add"}}', '{"id":5}']
    got = [json.loads(r.value) for r in features.serve(spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1), tools_).collect()]
    by = {g["id"]: g.get("result", g.get("error", {}).get("code")) for g in got}
    assert by[1] == 3 and by[2] == {"tools": ["add"]} and by[3] == -32601 and by[4] == -32602 and by[5] == -32600 and len(got) == 6


def test_tools(spark):
    named = tools.by_name()
    assert len(named) == 11 and all(t.definition()["inputSchema"]["additionalProperties"] is False for t in named.values())
    from quillon import registry

    registry.load()
    assert all(t.query in registry.QUERIES for t in named.values())
    got = named["comparability"].call(spark, "/root/testdata/sf0.001", {"standing": "classified", "limit": 3})
    assert len(got["data"]) == 3 and got["contract"]["truncated"] and got["cuts"] == []
    with pytest.raises(ValueError):
        named["comparability"].call(spark, "/root/testdata/sf0.001", {"nope": 1})
    with pytest.raises(ValueError):
        tools.by_name(tools.TOOLS * 2)
