"""An index follows its tables, and searches never see half of it."""

from __future__ import annotations

import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from quillon import registry
from quillon.operators import search as L
from quillon.sources import store

registry.load()


def entities(spark, names):
    return spark.createDataFrame([("strain", i, n, "body text", 2000, 0.5) for i, n in enumerate(names)], "kind string, id long, name string, body string, year int, evidence double")


def tables(folder, texts):
    pq.write_table(pa.table({"doc_id": range(len(texts)), "text": texts, "lang": ["en"] * len(texts), "source": ["s"] * len(texts), "n_chars": [len(t) for t in texts]}), f"{folder}/documents.parquet")
    pq.write_table(pa.table({"doc_id": [0], "quality": pa.array([1], pa.int32()), "toxic": pa.array([0], pa.int32())}), f"{folder}/labels.parquet")


def test_a_replaced_table_makes_the_index_stale(spark, tmp_path):
    tables(tmp_path, ["license one", "nothing", "license three"])
    run = lambda: {r.doc_id for r in registry.QUERIES["bm25"](spark, str(tmp_path)).collect()}
    assert run() == {0, 2} == run()
    tables(tmp_path, ["nothing one", "license", "nothing three"])  # same file name, number of rows and length
    os.utime(tmp_path / "documents.parquet", (1, 1))
    assert run() == {1}


def test_fingerprint_is_that_of_the_files(spark, tmp_path):
    tables(tmp_path, ["a", "b"])
    read = lambda: store.fingerprint(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    first = read()
    assert first == read()
    os.utime(tmp_path / "documents.parquet", (5, 5))
    assert read() != first


def test_versions_are_built_aside(spark, tmp_path):
    path = str(tmp_path / "index")
    assert L.index_status(spark, path, "s1") == "missing"
    with pytest.raises(ValueError):
        L.bm25(spark, path, [["alpha"]])
    L.build_index(entities(spark, ["alpha", "beta"]), path, "s1")
    old = store.current_version(spark, path)
    reader = L.bm25(spark, path, [["alpha"]])  # looked up before the next build, read after it
    half = store.new_version(spark, path)
    os.makedirs(f"{half}/postings")  # a build that never ended
    assert store.current_version(spark, path) == old and L.index_status(spark, path, "s1") == "fresh"
    L.build_index(entities(spark, ["gamma", "delta", "alpha beta"]), path, "s2")
    assert L.index_status(spark, path, "s2") == "fresh" and L.index_status(spark, path, "s1") == "stale"
    assert {r.id for r in reader.collect()} == {0} and {r.id for r in L.bm25(spark, path, [["alpha"]]).collect()} == {2}
    assert [r.asDict() for r in L.index_report(spark, entities(spark, ["x"]), path, "s3").collect()] == [{"kind": "strain", "indexed": 3, "present": 1, "status": "stale"}]
    for k in range(3):
        L.build_index(entities(spark, ["gamma"]), path, f"t{k}")
    left = store.versions(spark, path)
    assert not os.path.exists(old) and not os.path.exists(half) and sum(whole for _, _, whole in left) <= 3
