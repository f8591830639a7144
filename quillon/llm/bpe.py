"""Byte-level BPE: vocabularies, merges with a heap over linked bytes, a minimal perfect hash, and operators.

Operators: `encode_decode` (operator 8) and `count_tokens` (operator 3).
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from quillon.llm import pretoken

#: The splitting pattern of the public byte-level vocabularies (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in .json vocabularies, by rule: printable Latin-1 bytes stand
    for themselves, the others for the letters from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@dataclass
class Vocabulary:
    """Token bytes by id, the merges, and special strings.

    ranks has the rank of each merge by left id << 32 | right id; made has the id that a rank's merge makes.
    """

    tokens: list[bytes]
    by_bytes: dict[bytes, int]
    special: dict[str, int]
    ranks: dict[int, int]
    made: Sequence[int]
    #: whether the library gives a pre-token that is in the vocabulary its own id without merging
    direct: bool

    @classmethod
    def from_file(cls, path: str) -> Vocabulary:
        """From a .tiktoken rank file or a byte-level BPE .json file."""
        if path.endswith(".tiktoken"):
            with open(path, "rb") as f:
                by_bytes = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
            tokens = [b""] * (max(by_bytes.values()) + 1)
            ranks = {}
            for t, i in by_bytes.items():
                tokens[i] = t
                for k in range(1, len(t)):  # any two tokens that join to a token may merge, by its rank
                    if (a := by_bytes.get(t[:k])) is not None and (b := by_bytes.get(t[k:])) is not None:
                        ranks[a << 32 | b] = i
            return cls(tokens, by_bytes, {}, ranks, range(len(tokens)), True)
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        letters = byte_letters()
        special = {x["content"]: x["id"] for x in data["added_tokens"]}
        ids = data["model"]["vocab"]
        by_bytes = {bytes(letters[c] for c in t): i for t, i in ids.items() if t not in special}
        tokens = [b""] * (max([*ids.values(), *special.values()]) + 1)
        for t, i in by_bytes.items():
            tokens[i] = t
        ranks, made = {}, []
        for rank, m in enumerate(data["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            ranks[ids[a] << 32 | ids[b]] = rank
            made.append(ids[a + b])
        return cls(tokens, by_bytes, special, ranks, made, bool(data["model"].get("ignore_merges")))


def merge_bytes(piece: bytes, vocab: Vocabulary) -> list[int]:
    """BPE of one pre-token: a heap of merges over a doubly linked list of bytes; the lowest rank goes first,
    and of equal ranks the leftmost. An entry of the heap is rank << 32 | place; it holds while rank_at[place] is
    still that rank."""
    ids = [vocab.by_bytes[piece[i : i + 1]] for i in range(len(piece))]
    n = len(ids)
    get, made = vocab.ranks.get, vocab.made
    rank_at = [get(ids[i] << 32 | ids[i + 1], -1) for i in range(n - 1)]
    rank_at.append(-1)
    heap = [r << 32 | i for i, r in enumerate(rank_at) if r >= 0]
    if not heap:
        return ids
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heapq.heapify(heap)
    push, pop = heapq.heappush, heapq.heappop
    while heap:
        x = pop(heap)
        i, r = x & 0xFFFFFFFF, x >> 32
        if rank_at[i] != r:
            continue  # a neighbour has been merged meanwhile
        j = after[i]
        new = ids[i] = made[r]
        ids[j] = rank_at[j] = -1
        k = after[i] = after[j]
        rank_at[i] = -1
        if k < n:
            before[k] = i
            if (r := get(new << 32 | ids[k], -1)) >= 0:
                rank_at[i] = r
                push(heap, r << 32 | i)
        p = before[i]
        if p >= 0:
            rank_at[p] = r = get(ids[p] << 32 | new, -1)
            if r >= 0:
                push(heap, r << 32 | p)
    return [x for x in ids if x >= 0]


def _strings(vocab: Vocabulary) -> dict[str, int]:
    """Tokens that are whole UTF-8 strings; no other can be a pre-token."""
    found = {}
    for i, t in enumerate(vocab.tokens):
        try:
            s = t.decode()
        except UnicodeDecodeError:
            continue
        if s and vocab.by_bytes.get(t) == i:
            found[s] = i
    return found


def whole_tokens(vocab: Vocabulary) -> dict[str, int]:
    """The offline proof: vocabulary strings that are one pre-token and that the merges turn into one token.

    A string that the merges never reach whole is left out, and so goes through the merges each time.
    """
    pattern = regex.compile(PATTERN)
    return {s: i for s, i in _strings(vocab).items() if pattern.fullmatch(s) and len(pattern.findall(s)) == 1 and len(merge_bytes(vocab.tokens[i], vocab)) == 1}


_memos: dict[tuple[str, str], tuple[pretoken.Memo, Vocabulary]] = {}


def encoder(path: str) -> tuple[pretoken.Memo, Vocabulary]:
    """Two-tier encoder of this process: the perfect hash of the vocabulary's strings comes first; pre-tokens that it
    doesn't have are merged with the heap, once each while a bounded memo keeps them."""
    if ("two-tier", path) not in _memos:
        vocab = Vocabulary.from_file(path)
        strings = _strings(vocab) if vocab.direct else whole_tokens(vocab)
        memo = pretoken.Memo(lambda words: [merge_bytes(w.encode(), vocab) for w in words], first=pretoken.PerfectHash(list(strings)), first_ids=list(strings.values()))
        _memos["two-tier", path] = (memo, vocab)
    return _memos["two-tier", path]


def counter(path: str, proven: dict[str, int]) -> tuple[pretoken.Memo, Vocabulary]:
    """Counter of this process: proven whole tokens count as one directly, the rest is merged."""
    if ("count", path) not in _memos:
        vocab = Vocabulary.from_file(path)
        memo = pretoken.Memo(lambda words: [merge_bytes(w.encode(), vocab) for w in words], first=pretoken.PerfectHash(list(proven)), first_ids=list(proven.values()))
        _memos["count", path] = (memo, vocab)
    return _memos["count", path]


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """Strings of an Arrow column; null is the empty text."""
    return [x or "" for x in column.to_pylist()]


#: Bytes of text that are encoded at a time.
SLICE = 1 << 21


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about SLICE bytes of a text column; a longer text is a slice of its own."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    edges = [0, *(np.flatnonzero(np.diff(np.cumsum(size) // SLICE)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges[:-1], edges[1:]):
        if a < b:
            yield batch.slice(a, b - a)


def encode_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode each whole text by a byte-level vocabulary and decode it again (operator 8).

    One narrow stage: (id, n_tokens, ids_sha256, decoded_sha256), with_ids adds the ids as array<int>. A null text
    is the empty text; an empty text has no ids; a null id and repeated rows stay as they are; other columns are
    not read. Very long texts are cut only where the pattern cuts them anyway, so memory is bounded by one text.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, vocab = encoder(vocabulary)
        for batch in (part for whole in batches for part in slices(whole, 1)):
            ids, at = pretoken.encode(texts_of(batch.column(1)), memo)
            raw = ids.astype("<u4").tobytes()
            n, digest, decoded, lists = np.diff(at), [], [], []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                digest.append(hashlib.sha256(raw[4 * a : 4 * b]).hexdigest())
                decoded.append(hashlib.sha256(b"".join(map(vocab.tokens.__getitem__, ids[a:b].tolist()))).hexdigest())
            columns = [batch.column(0), pa.array(n), pa.array(digest, pa.string()), pa.array(decoded, pa.string())]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)])

    out = docs.select(id_col, text_col).toDF("id", "text").mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
    return out.withColumnRenamed("id", id_col)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token counts of each whole text (operator 3): (id, n_bytes, n_tokens, over_limit).

    The vocabulary's whole tokens are proven once on the driver (bounded by the vocabulary) and sent to the tasks.
    A special string counts as one token, as the tokenizers library does by default. A null text is the empty text
    with 0 tokens; a null id and repeated rows stay; other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    proven = docs.sparkSession.sparkContext.broadcast(whole_tokens(Vocabulary.from_file(vocabulary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, vocab = counter(vocabulary, proven.value)
        for batch in batches:
            texts = texts_of(batch.column(1))
            n = pretoken.count(texts, memo, vocab.special)
            size = np.fromiter((len(t.encode()) for t in texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(n), pa.array(n > limit)], names=["id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(id_col, text_col).toDF("id", "text").mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
