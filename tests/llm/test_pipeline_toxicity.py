"""The pipeline's toxicity stage keeps what operator 4 doesn't reject."""

from __future__ import annotations

import math

import numpy as np

import corpus_pipeline
from quillon.llm import toxicity


def test_stage_drops_what_the_operator_predicts(spark, tmp_path, monkeypatch):
    # a curve without weights scores a text by its length alone: 9 letters 0.4, 99 letters 0.2
    logit = lambda p: math.log(p / (1 - p))
    slope = (logit(0.2) - logit(0.4)) / (math.log1p(99) - math.log1p(9))
    curve = np.array([0, 0, slope, logit(0.4) - slope * math.log1p(9)])
    monkeypatch.setattr(toxicity, "train", lambda *a, **k: toxicity.Model(np.zeros(toxicity.BASE**4, np.float32), curve))
    docs = spark.createDataFrame([(1, "a" * 9), (2, "a" * 99)], "doc_id long, text string")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    said = {r.doc_id: r.predicted for r in toxicity.score(docs, toxicity.train()).collect()}
    assert said == {1: 1, 2: 0}
    assert [r.doc_id for r in corpus_pipeline.reject_toxic(spark, docs, str(tmp_path)).collect()] == [2]
