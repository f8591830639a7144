"""Clashing names, null ids, long texts and empty tables for every operator, and a kernel by brute force."""

from __future__ import annotations

import itertools
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

from quillon.llm import bpe, exact_dedup, fingerprint, mixing, near_dup, records, repeats, shared, toxicity, url_filter

#: Names that operators use inside.
NAMES = ["id", "text_", "h", "__h", "name", "node", "gone", "key", "uid", "part", "tie", "row", "n", "__id", "__label", "rank", "words", "source_size", "target", "host", "path"]
LONG = "lorem ipsum dolor sit amet " * 12_000


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b  c d e f"), (None, None), (2, ""), (3, " \n\t"), (4, LONG), (5, LONG + "end"), (6, None)]
    rows = [(i, t, f"s{k % 2}" if k % 3 else None, *range(len(NAMES))) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{c}` int" for c in NAMES))


def test_every_operator_on_odd_rows(spark, docs, tmp_path):
    gpt, multi = P.path("byte_bpe_50k.json"), P.path("byte_bpe_multi_50k.tiktoken")
    n = docs.count()
    model = toxicity.train(docs, spark.createDataFrame([(1, 1, 1), (2, 0, 5), (4, 0, 9), (None, 1, 0)], "doc_id long, toxic int, __id int"))
    runs = {
        "op2": lambda d: near_dup.near_groups(d), "op3": lambda d: bpe.count_tokens(d, gpt), "op4": lambda d: toxicity.score(d, model), "op5": lambda d: records.token_records(d, gpt),
        "op6": lambda d: mixing.mix(d), "op7": lambda d: fingerprint.fingerprints(d), "op8": lambda d: bpe.encode_decode(d, multi), "op9": lambda d: exact_dedup.exact_groups(d), "op10": lambda d: repeats.repeated_spans(d),
    }
    for name, run in runs.items():
        assert run(docs).count() == n, name
        assert run(docs.limit(0)).count() == 0, name
    for name, run in {"one_of_each": near_dup.one_of_each, "exact_dedup": exact_dedup.exact_dedup, "harmless": lambda d: toxicity.harmless(d, model, 2.0), "mixed": mixing.mixed_documents, "without_repeats": repeats.without_repeats}.items():
        out = run(docs)
        assert out.columns == docs.columns and 0 < out.count() <= 2 * n, name
        assert run(docs.limit(0)).count() == 0, name
    assert near_dup.one_of_each(docs).where("doc_id IS NULL").count() == 2  # rows without an id stay
    assert exact_dedup.exact_dedup(docs).count() == 5


def test_long_urls_and_clashing_names(spark):
    rows = [(i, f"http://h.net/{'x' * 50_000}/{i}", 1, 2, 3, 4) for i in range(6)] + [(None, None, 1, 2, 3, 4)]
    df = spark.createDataFrame(rows, "page_id long, url string, host int, path int, id int, template int")
    assert url_filter.judge(df).count() == 7


def test_rows_without_an_id_draw_apart(spark):
    df = spark.createDataFrame([(None, f"w{i} " * 10, "a" if i % 2 else "b") for i in range(400)], "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    for target in {r.target for r in got}:
        mine = [r for r in got if r.target == target]
        assert abs(sum(r.taken for r in mine) - target) <= 20


def test_range_parts_are_in_order_and_even(spark):
    rows = [(7, f"t{i}") for i in range(300)] + [(i, "x") for i in range(300)] + [(None, f"n{i}") for i in range(200)]
    df = spark.createDataFrame(rows, "id long, text string")
    for last in (True, False):
        part, count = shared.range_parts(df, "id", shared.tie(df["text"]), 16, last)
        got = df.select("id", shared.tie(df["text"]).alias("tie"), part.alias("p")).collect()
        key = lambda r: ((r.id is None) == last, r.id or 0, r.tie)
        ordered = sorted(got, key=key)
        assert [r.p for r in ordered] == sorted(r.p for r in got) and max(r.p for r in got) < count
        assert max(Counter(r.p for r in got).values()) < 160


def kernel_weights(s):
    """Weights of a string's four-letter sequences, by trying all places."""
    code = [ord(c) - 96 for c in s.lower() if c.isalpha()]
    out = Counter()
    for at in itertools.combinations(range(len(code)), 4):
        if at[3] - at[0] <= 5:
            out[sum(code[a] * toxicity.BASE ** (3 - i) for i, a in enumerate(at))] += toxicity.DECAY ** (at[3] - at[0] - 3)
    return out


def test_kernel_by_brute_force():
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdef", k=rng.randint(0, 14))) for _ in range(60)]
    for w in words:
        got, want = toxicity.profile(w), kernel_weights(w)
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    kernel = lambda a, b: sum(v * b[k] for k, v in a.items())
    plain, gapped, other = kernel_weights("stupid"), kernel_weights("stuxpid"), kernel_weights("flower")
    assert kernel(plain, gapped) > 0 == kernel(plain, other)
    # the table of weights scores a text as the kernel does: the sum over the sequences that start in a window
    v = np.zeros(toxicity.BASE**4, np.float32)
    for k, x in plain.items():
        v[k] = x
    for text in ["a stu.pid thing", "st*upid", "nothing of it", ""]:
        a, _ = toxicity.letters([text])
        whole = sum(kernel(plain, kernel_weights(w)) for w in "".join(c for c in text if c.isalpha() or c == " ").split())
        assert abs(float(toxicity.starts(a, v).sum()) - whole) < 1e-4
