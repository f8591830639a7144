"""The toxicity model is fitted on all that its constants promise, in blocks."""

from __future__ import annotations

import numpy as np

from quillon.llm import toxicity


def test_letters_in_blocks(monkeypatch):
    texts = ["grub*nik, and more", "", "ÄÖ 12", "x" * 70, "last one"]
    whole = toxicity.letters(texts)
    monkeypatch.setattr(toxicity, "CHUNK", 40)
    codes, begins = toxicity._in_blocks(texts)
    assert np.array_equal(codes, whole[0]) and np.array_equal(begins, whole[1])


def test_words_seen_once_are_landmarks_and_blocks_change_nothing(monkeypatch):
    texts = [f"plain words number {'abcdefghij'[i]} stand here. And again." for i in range(10)] + [f"plain words with {w} here." for w in ("grubnik", "vexpaw", "zorblat", "zorblat")]
    labels = [0] * 10 + [1] * 4
    model = toxicity.fit(texts, labels)
    assert min(model.scores(["so grubnik it is", "so vexpaw it is"])) > model.scores(["so plain it is"])[0]
    monkeypatch.setattr(toxicity, "CHUNK", 60)
    assert np.allclose(toxicity.fit(texts, labels).scores(texts), model.scores(texts))


def test_the_sample_is_of_whole_texts(spark):
    """Insults at both ends of long documents teach; the bound on the sample leaves out documents, not parts of them."""
    calm = "the river runs slowly by the old mill and nobody minds. "
    rows = [(i, ("you stupid moron. " + calm * 4000 if i % 2 else calm * 4000 + " you stupid moron.") if i < 40 else calm * (1 + i % 3)) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(120)], "doc_id long, toxic int")
    probe = spark.createDataFrame([(1, "you stupid moron."), (2, calm), (3, calm * 4000 + " you stupid moron."), (4, "you stupid moron. " + calm * 4000)], "doc_id long, text string")
    for most in (24_000_000, 900_000):
        got = {r.doc_id: r.predicted for r in toxicity.score(probe, toxicity.train(docs, labels, sample_chars=most)).collect()}
        assert got == {1: 1, 2: 0, 3: 1, 4: 1}
    assert toxicity.train(docs, labels, sample_chars=1) is not None  # one document of either class
