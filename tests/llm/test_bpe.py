"""Byte-level BPE against the public libraries, records, and token counts."""

from __future__ import annotations

import base64
import hashlib
import json
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import Row
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillon.llm import bpe, pretoken, records, shared

MULTI, GPT = P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.json")
PIECES = ["a", "b", "s", "re", "ll", "'", "'s", "'ll", " ", "  ", "\n", "\t", "1", "23", "é", "ß", "中", "!", "?", "<|endoftext|>", "\U0001f600", "́", "\x00", "Ᲊ", " ", " ", "'d"]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(MULTI, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts(n: int) -> list[str]:
    rng = random.Random(3)
    return ["".join(rng.choices(PIECES, k=rng.randint(0, 30))) for _ in range(n)] + ["", " ", "\n\n", "it's 'really' they'll", "x" * 5000]


def test_encode_is_the_librarys(library):
    memo, _ = bpe.encoder(MULTI)
    cases = texts(2000)
    ids, at = pretoken.encode(cases, memo)
    for i, t in enumerate(cases):
        assert ids[at[i] : at[i + 1]].tolist() == library.encode_ordinary(t), t


def test_counts_are_the_librarys():
    vocab = bpe.Vocabulary.from_file(GPT)
    proven = bpe.whole_tokens(vocab)
    memo, _ = bpe.counter(GPT, proven)
    cases = texts(2000)
    expected = [len(e.ids) for e in Tokenizer.from_file(GPT).encode_batch(cases, add_special_tokens=False)]
    assert pretoken.count(cases, memo, vocab.special).tolist() == expected


def test_every_proven_string_is_one_token():
    vocab = bpe.Vocabulary.from_file(GPT)
    proven = bpe.whole_tokens(vocab)
    words = sorted(proven)[::97]
    assert all(len(e.ids) == 1 and e.ids[0] == proven[w] for w, e in zip(words, Tokenizer.from_file(GPT).encode_batch(words, add_special_tokens=False)))


def test_long_texts_are_cut_without_effect(library, monkeypatch):
    text = " ".join(random.Random(1).choices(["über", "word", "it's", "12", "\n", "a"], k=4000))
    memo, _ = bpe.encoder(MULTI)
    monkeypatch.setattr(pretoken, "CHUNK", 500)
    assert len(list(pretoken.cut(text, 500))) > 5
    pieces = list(pretoken.cut(text, 500))
    assert "".join(pieces) == text
    ids = [i for p in pieces for i in library.encode_ordinary(p)]
    assert ids == library.encode_ordinary(text) == pretoken.encode([text], memo)[0].tolist()


def test_memo_starts_anew_when_full():
    calls = []

    def resolve(words):
        calls.extend(words)
        return [(len(w),) for w in words]

    memo = pretoken.Memo(resolve, cap=50)
    for k in range(6):
        ids, _ = pretoken.encode([" ".join(f"w{chr(97 + k)}{chr(97 + i)}" for i in range(26))], memo)
        assert ids.tolist() == [3] + [4] * 25
        assert memo.n <= 52
    assert len(calls) > 100


def test_pretokens_with_one_hash_stay_apart(library, monkeypatch):
    """All pre-tokens of one length get one hash; ids are the library's all the same."""
    monkeypatch.setattr(pretoken, "hashes", lambda points, starts, ends: ((ends - starts).astype(np.uint64) << np.uint64(40)) | np.uint64(1))
    vocab = bpe.Vocabulary.from_file(MULTI)
    memo = pretoken.Memo(lambda words: [bpe.merge_bytes(w.encode(), vocab) for w in words])
    cases = texts(200) + ["ab cd ef gh", "abc abd abe"]
    for _ in range(2):
        ids, at = pretoken.encode(cases, memo)
        for i, t in enumerate(cases):
            assert ids[at[i] : at[i + 1]].tolist() == library.encode_ordinary(t), t


def test_perfect_hash_comes_first(library):
    memo, vocab = bpe.encoder(MULTI)
    fixed = memo.fixed[0]
    memo.clear()
    pretoken.encode(["the house and the tree"], memo)
    assert memo.n == fixed  # nothing was merged


@pytest.mark.parametrize("n", [0, 1, 2, 7, 500, 5000])
def test_perfect_hash_is_minimal_and_knows_strangers(n):
    keys = [f"key{i}" for i in range(n)]
    h = pretoken.PerfectHash(keys)
    assert h.find(keys) == list(range(n))
    assert set(h.find(["stranger", "x", "key99999"])) == {-1}
    assert sorted(h.slots.tolist()) == list(range(n))


def test_round_trip_query(spark, library):
    rows = [Row(doc_id=i, text=t, ids="x", n_tokens="clash") for i, t in enumerate([None, "", "it's ünïcode\n\n ok", "a" * 3000, "same", "same"])] + [Row(doc_id=None, text="no id", ids="x", n_tokens="y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens string")
    out = {(r.doc_id, r.ids_sha256): r for r in bpe.encode_decode(df, MULTI).collect()}
    assert bpe.encode_decode(df, MULTI).count() == 7
    for r in rows:
        ids = library.encode_ordinary(r.text or "")
        digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        got = out[r.doc_id, digest]
        assert got.n_tokens == len(ids)
        assert got.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert bpe.encode_decode(df.limit(0), MULTI).count() == 0


def test_count_query(spark):
    df = spark.createDataFrame([(i, t, 7, "c") for i, t in [(1, None), (2, "hello world"), (None, "x " * 600), (2, "hello world")]], "doc_id long, text string, n_tokens int, id string")
    got = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in bpe.count_tokens(df, GPT).collect()}
    n = len(Tokenizer.from_file(GPT).encode("x " * 600, add_special_tokens=False).ids)
    assert got == {(1, 0, 0, False), (2, 11, 2, False), (None, 1200, n, True)}


# ---------------------------------------------------------------- records


def slow_crc32c(data: bytes) -> int:
    s = 0xFFFFFFFF
    for b in data:
        s ^= b
        for _ in range(8):
            s = s >> 1 ^ (0x82F63B78 if s & 1 else 0)
    return s ^ 0xFFFFFFFF


def test_crc32c():
    rng = random.Random(5)
    parts = [bytes(rng.randrange(256) for _ in range(n)) for n in (0, 1, 3, 4, 5, 255, 256, 257, 512, 1000)] + [b"123456789"]
    data = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.cumsum([len(p) for p in parts])
    got = records.crc32c(data, ends - [len(p) for p in parts], ends).tolist()
    assert got == [slow_crc32c(p) for p in parts]
    assert got[-1] == 0xE3069283


def test_records_round_trip(spark, tmp_path):
    cases = [(5, "five"), (1, None), (3, "<|endoftext|> three"), (2, "zwei " * 700), (None, "none"), (3, "again three"), (9, ""), (None, "none"), (4, "lang " * 90_000)]
    cases += [(7, f"many rows of one id {i}") for i in range(40)] + [(None, f"many without {i}") for i in range(30)]
    df = spark.createDataFrame([(i, t, "c", "d") for i, t in cases], "doc_id long, text string, part string, id string")
    got = [tuple(r) for r in records.token_records(df, GPT, 0, f"file://{tmp_path}/r").collect()]
    library = Tokenizer.from_file(GPT)
    hashed = {r.text: r.t for r in df.select(F.coalesce("text", F.lit("")).alias("text"), shared.tie(F.coalesce("text", F.lit(""))).alias("t")).collect()}
    start, expected = 0, []
    for key, t in sorted(cases, key=lambda x: (x[0] is None, x[0] or 0, hashed[x[1] or ""])):
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        expected.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(got, key=lambda x: x[1]) == expected
    assert records.token_records(df.limit(0), GPT, 0, f"file://{tmp_path}/empty").count() == 0


def test_plain_words_are_merged_in_groups_with_the_librarys_ids():
    tokenizer, own = records.library(GPT), Tokenizer.from_file(GPT)
    assert len(tokenizer.pre_tokenizer.pre_tokenize_str("a group of plain words, größer, 12 слов")) == 1
    assert tokenizer.get_vocab_size() == own.get_vocab_size()
    rng = random.Random(9)
    more = PIECES + ["x" * 100, "y" * 101, "\u30fc", "\u30fb", "\u05d9\u05c7", "\u0627\u0600", "\x85", "\x1c", "<0xE2>", "<|endo", "ª", "²", "слово", " the", " l'été"]
    cases = texts(2000) + ["".join(rng.choices(more, k=60)) for _ in range(500)] + [" ".join("".join(rng.choices(more, k=2)) for _ in range(300)) for _ in range(20)]
    ids, at = records.encode(cases, tokenizer)
    for i, e in enumerate(own.encode_batch(cases, add_special_tokens=False)):
        assert ids[at[i] : at[i + 1]].tolist() == e.ids, cases[i]


def test_merges_across_a_cut_keep_the_files_own_tokenizer(tmp_path):
    assert records.uncrossed([(b"a", b"b"), (b" ", b"a"), (b"\xc3", b"\xa9"), (b" ", b"\xc3")])
    assert not any(records.uncrossed([m]) for m in [(b"a", b" "), (b"a", b"1"), (b"a", b"."), (b"\xa9", b"1"), (b"a", b"\xc2")])
    with open(GPT, encoding="utf-8") as f:
        data = json.load(f)
    data["model"]["vocab"]["aĠ"] = 50257
    data["model"]["merges"].insert(0, ["a", "Ġ"])
    path = tmp_path / "crossing.json"
    path.write_text(json.dumps(data), encoding="utf-8")
    own = Tokenizer.from_file(str(path))
    ids, _ = records.encode(["a b a b"], records.library(str(path)))
    assert ids.tolist() == own.encode("a b a b", add_special_tokens=False).ids


def test_damage_is_found_and_reads_may_be_shuffled(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text number {i}") for i in range(40)], "doc_id long, text string")
    index = records.write_records(df, GPT, f"file://{tmp_path}/r")
    again = records.read_records(index.orderBy("size", "id"), f"file://{tmp_path}/r", records._crc, "ids_crc32 long")
    assert again.count() == 40
    path = sorted((tmp_path / "r").glob("part-*.rec"))[0]
    raw = bytearray(path.read_bytes())
    raw[records.HEAD] ^= 1
    path.write_bytes(bytes(raw))
    with pytest.raises(Exception, match="damaged"):
        again.collect()


def test_slices_hold_all_rows_in_order(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(bpe, "SLICE", 10)
    texts = ["", None, "abc", "x" * 35, "de", "", "y" * 9, "z" * 10, None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["id", "text"])
    parts = list(bpe.slices(batch, 1))
    assert len(parts) > 3 and all(p.num_rows for p in parts)
    assert [x for p in parts for x in p.column(1).to_pylist()] == texts and list(bpe.slices(batch.slice(0, 0), 1)) == []
