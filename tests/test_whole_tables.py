"""Queries over tables that reach beyond the bounds some of them once had."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillon import registry
from quillon.plans.aggregates import matrix_cpm
from quillon.sources.standins import Tables

registry.load()


def write(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


@pytest.fixture(scope="module")
def documents(spark, tmp_path_factory):
    """Documents with ids beyond 300, one of them longer than 3000 letters, and a benchmark."""
    folder = str(tmp_path_factory.mktemp("whole"))
    long = "x" * 4000 + " the end of the text\nnext line " + "ACG" * 700
    texts = {5: "0123456789a quote it is", 305: "a quote, and a quote", 45: "none", 9000: long}
    write(spark, folder, "documents", [(i, s, "en", "s", len(s)) for i, s in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    write(spark, folder, "benchmark", [(5, "a quote"), (25, "a quote"), (0, "ACG")], "item_id long, text string")
    return folder, texts


def collected(spark, name, folder):
    return registry.QUERIES[name](spark, folder).collect()


def test_verify_span_reads_all_documents(spark, documents):
    folder, _ = documents
    got = {(r.doc_id, r.item_id): r.verdict for r in collected(spark, "verify_span", folder)}
    assert got == {(5, 5): "exact", (305, 25): "ambiguous", (45, 5): "absent", (9000, 0): "ambiguous"}


def test_sections_and_excerpts_of_all_documents(spark, documents):
    folder, texts = documents
    papers = {r.doc_id: r.text for r in Tables(spark, folder).v_paper.collect()}
    assert set(papers) == set(texts) and all(texts[i] in t for i, t in papers.items())
    at = {}
    for r in sorted(collected(spark, "split_sections", folder), key=lambda r: (r.doc_id, r.start_pos)):
        assert r.start_pos == at.get(r.doc_id, 0)  # sections tile the whole text
        at[r.doc_id] = r.end_pos
    assert at == {i: len(t) for i, t in papers.items()}
    assert {r.doc_id for r in collected(spark, "excerpt_offsets", folder)} == {i for i in texts if i % 5 or i % 2 == 0}


def test_nearest_occurrence_in_long_documents(spark, documents):
    folder, texts = documents
    want = {}
    for i, s in texts.items():
        places = [k for k in range(len(s)) if s.startswith(" the", k)]
        if places:
            want[i] = min(abs(k - len(s) // 2) for k in places)
    assert 9000 in want
    assert {r.doc_id: r.distance for r in collected(spark, "nearest_occurrence", folder)} == want


def test_sequences_of_whole_texts(spark, documents):
    folder, texts = documents
    whole = {i: "".join(c for c in s.upper() if c in "ACGT") for i, s in texts.items()}
    assert len(whole[9000]) > 2100  # all of it beyond the first 900 letters
    assert {r.doc_id: r.n for r in collected(spark, "codons", folder)} == {i: len(s) // 3 for i, s in whole.items()}
    assert {r.doc_id: r.rc for r in collected(spark, "revcomp", folder)} == {i: s[::-1].translate(str.maketrans("ACGT", "TGCA")) for i, s in whole.items()}
    assert all(len(r.protein) == len(whole[r.doc_id]) // 3 for r in collected(spark, "translate", folder))


SF = "/root/testdata/sf0.01"


def test_queries_read_whole_tables(spark):
    t = Tables(spark, SF)
    for name, table in {"json_flatten_diff": t.events, "parse_timepoint": t.lineitem, "running_budget": t.orders, "validate_records": t.v_measurement}.items():
        assert registry.QUERIES[name](spark, SF).count() == table.count(), name
    total = lambda name, c: registry.QUERIES[name](spark, SF).agg(F.sum(c)).first()[0]
    assert total("gff_parse", "children") == t.events.count()
    assert total("rankable_classes", "n") == t.v_measurement.join(t.v_context, F.col("product_id") == F.col("context_id")).count()
    kinds = t.v_context.select("feedstock", F.col("context_id") % 40).distinct().count()
    assert registry.QUERIES["facet_differences"](spark, SF).count() == 4 * kinds
    products = t.v_product.join(t.v_participant, F.col("metabolite_id") == F.col("product_id")).select("product_id").distinct().count()
    assert registry.QUERIES["gene_page"](spark, SF).count() == products
    assert registry.QUERIES["transport_gaps"](spark, SF).where("reaction_id % 10 <> 0").count()


def test_cpm_of_all_and_of_wanted_genes(spark):
    t = Tables(spark, SF)
    assert registry.QUERIES["matrix_cpm"](spark, SF).count() == t.v_matrix.count()
    genes = [r.gene for r in t.v_matrix.select("gene").distinct().orderBy("gene").limit(3).collect()]
    everything = {tuple(r) for r in matrix_cpm(t).where(F.col("gene").isin(genes)).collect()}
    assert {tuple(r) for r in matrix_cpm(t, genes).collect()} == everything
