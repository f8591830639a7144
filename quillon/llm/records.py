"""Token ids as length-delimited binary records with masked checksums and a separate offset index (operator 5)."""

from __future__ import annotations

import json
import os
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from quillon.llm import shared
from quillon.llm.bpe import PATTERN, byte_letters, texts_of

# ---------------------------------------------------------------- checksums

#: Castagnoli polynomial, reflected, and the constant that masks a checksum stored beside its data (fixed values).
POLYNOMIAL, MASK_DELTA = 0x82F63B78, 0xA282EAD8
#: Bytes of a lane, and lanes that advance together.
LANE, TOGETHER = 256, 1 << 13


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """step[b]: state after byte b; half[k, x]: state whose half k was x, after four zero bytes; shift[k, b]: state whose byte k was b, after LANE zeros."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLYNOMIAL), t >> 1)
    half = np.stack([np.arange(1 << 16, dtype=np.uint32) << np.uint32(16 * k) for k in range(2)])
    for _ in range(4):
        half = t[half & 0xFF] ^ (half >> 8)
    shift = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    for _ in range(LANE):
        shift = t[shift & 0xFF] ^ (shift >> 8)
    return t, half, shift


_STEP, _HALF, _SHIFT = _tables()


def _copy(to: np.ndarray, places: np.ndarray, source: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
    """Copy the slices [start, end) of a byte array to places in another."""
    out, data = memoryview(to), memoryview(source)
    for p, a, b in zip(places.tolist(), starts.tolist(), ends.tolist()):
        out[p : p + b - a] = data[a:b]


def crc32c(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32C of the slices [start, end) of a byte array, all together.

    Every slice is cut into lanes, the first filled up with zeros in front, which leave the zero state alone; lanes
    advance four bytes at a step and are then joined in order.
    """
    n = (ends - starts).astype(np.int64)
    longest = int(n.max(initial=0))
    width = LANE if longest > LANE else max(4, -(-longest // 4) * 4)
    lanes = np.maximum(1, -(-n // width))
    first = np.cumsum(lanes) - lanes
    front = (first + lanes) * width - n
    grid = np.zeros(int(lanes.sum()) * width, np.uint8)
    _copy(grid, front, data, starts, ends)
    # the initial state, all ones, is the same as inverting the first four bytes; shorter slices are done below
    for k in range(4):
        at = front[n >= 4] + k
        grid[at] ^= 0xFF
    words = grid.view("<u4").reshape(-1, width // 4)
    state = np.zeros(len(words), np.uint32)
    for a in range(0, len(words), TOGETHER):
        s = state[a : a + TOGETHER]
        for word in np.ascontiguousarray(words[a : a + TOGETHER].T):
            s = s ^ word
            s = _HALF[0].take(s & 0xFFFF) ^ _HALF[1].take(s >> 16)
        state[a : a + TOGETHER] = s
    out = state[first].copy()
    todo = np.flatnonzero(lanes > 1)
    for i in range(1, int(lanes.max(initial=0))):
        todo = todo[lanes[todo] > i]
        s = out[todo]
        out[todo] = _SHIFT[0][s & 0xFF] ^ _SHIFT[1][s >> 8 & 0xFF] ^ _SHIFT[2][s >> 16 & 0xFF] ^ _SHIFT[3][s >> 24] ^ state[first[todo] + i]
    out ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(n < 4).tolist():
        s = 0xFFFFFFFF
        for b in data[starts[i] : ends[i]].tolist():
            s = int(_STEP[(s ^ b) & 0xFF]) ^ (s >> 8)
        out[i] = s ^ 0xFFFFFFFF
    return out


def masked(crc: np.ndarray) -> np.ndarray:
    """Checksums as they are stored: rotated by 15 bits, plus a constant."""
    return (crc >> np.uint32(15) | crc << np.uint32(17)) + np.uint32(MASK_DELTA)


# ---------------------------------------------------------------- frames

#: Bytes before and after a payload: its length, the length's checksum; the payload's checksum.
HEAD, TAIL = 12, 4


def frame(payload: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Framed records of payloads that stand in a row, and where each record begins."""
    sizes = sizes.astype(np.int64)
    begins = np.cumsum(sizes + HEAD + TAIL) - (sizes + HEAD + TAIL)
    out = np.zeros(int((sizes + HEAD + TAIL).sum()), np.uint8)
    ends = np.cumsum(sizes)
    lengths = np.ascontiguousarray(sizes.astype("<u8")).view(np.uint8)
    at8 = np.arange(len(sizes)) * 8
    heads = np.concatenate([lengths.reshape(-1, 8), masked(crc32c(lengths, at8, at8 + 8)).astype("<u4").view(np.uint8).reshape(-1, 4)], axis=1)
    out[(begins[:, None] + np.arange(HEAD)).ravel()] = heads.ravel()
    _copy(out, begins + HEAD, payload, ends - sizes, ends)
    tails = masked(crc32c(payload, ends - sizes, ends)).astype("<u4").view(np.uint8)
    out[(begins[:, None] + HEAD + sizes[:, None] + np.arange(TAIL)).ravel()] = tails
    return out, begins


def unframe(data: np.ndarray, begins: np.ndarray, sizes: np.ndarray, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Payload starts and ends of records, after checking lengths and checksums."""
    heads = data[begins[:, None] + np.arange(HEAD)]
    lengths = np.ascontiguousarray(heads[:, :8]).view("<u8").ravel().astype(np.int64)
    starts, ends = begins + HEAD, begins + HEAD + sizes
    at = np.arange(len(begins)) * 8
    good = lengths == sizes
    good &= masked(crc32c(np.ascontiguousarray(heads[:, :8]).ravel(), at, at + 8)) == np.ascontiguousarray(heads[:, 8:]).view("<u4").ravel()
    good &= masked(crc32c(data, starts, ends)) == np.ascontiguousarray(data[ends[:, None] + np.arange(TAIL)]).view("<u4").ravel()
    if not good.all():
        raise ValueError(f"{name}: record at byte {int(begins[~good][0])} is damaged")
    return starts, ends


# ---------------------------------------------------------------- the library's tokenizer

#: Characters that plain words are made of, as ranges: neither white space nor an apostrophe is among them.
PLAIN = (("!", "&"), ("(", "~"), ("\u00a1", "\u052f"))
#: The file's pattern behind up to 64 plain words of at most 100 characters in a row: it cuts wherever the file's does, save inside them.
GROUPED = "(?: ?(?>[" + "".join(f"{a}-{b}" for a, b in PLAIN) + r"]{1,100})(?!\S)){1,64}|" + PATTERN


def uncrossed(merges: Iterable[tuple[bytes, bytes]]) -> bool:
    """Whether no merge joins bytes across a cut that the file's pattern makes inside plain words.

    Then the pieces of a group of words are merged as they would be one by one. A merge's halves meet at a cut only between
    two characters, so the library is asked about every two plain characters that may stand there.
    """
    plain = {chr(c).encode() for a, b in PLAIN for c in range(ord(a), ord(b) + 1)} | {b" "}
    pairs: set[tuple[bytes, bytes]] = set()
    for a, b in set(merges):
        if b[0] & 0xC0 == 0x80:
            continue  # they meet inside a character
        start = next((i for i in range(len(a) - 1, -1, -1) if a[i] & 0xC0 != 0x80), 0)
        before, after = a[start:], b[: 1 + (b[0] >= 0xC0) + (b[0] >= 0xE0) + (b[0] >= 0xF0)]
        # bytes that aren't a whole character stand for all that end or begin so
        left = [before] if before in plain else [c for c in plain if c.endswith(before)]
        right = [after] if after in plain else [c for c in plain if c.startswith(after)]
        pairs.update((x, y) for x in left if x != b" " for y in right)  # groups hold no two spaces in a row
    cut = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    return all(len(cut((x + y).decode())) == 1 for x, y in pairs)


def grouped(data: dict) -> dict | None:
    """The tokenizer of a byte-level BPE file, spelled so that the library does less work for the same ids.

    ASCII bytes are spelled as themselves and all others as the library's byte fallback has them, so texts needn't be turned
    into letters for bytes first; whole groups of plain words are merged at once. Ids, merges, their order and special
    strings stay the file's. None for a file that isn't of this kind or whose merges cross the cuts.
    """
    model, ways, letters = data["model"], data.get("pre_tokenizer") or {}, byte_letters()
    special = {x["content"] for x in data["added_tokens"]}
    plain_model = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
    if not plain_model or data.get("normalizer") or (ways.get("type"), ways.get("add_prefix_space"), ways.get("use_regex")) != ("ByteLevel", False, True):
        return None
    spelled = {c: chr(b) if b < 0x80 else f"<0x{b:02X}>" for c, b in letters.items()}
    merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    strings = model["vocab"].keys() - special
    if not letters.keys() <= strings or not all(letters.keys() >= set(t) for t in strings) or any(len(t) == 1 for t in special):
        return None
    if not all(t in strings for m in merges for t in m) or not uncrossed((bytes(letters[c] for c in a), bytes(letters[c] for c in b)) for a, b in merges):
        return None

    def spell(t: str) -> str:
        return "".join(spelled[c] for c in t)

    vocab = {t if t in special else spell(t): i for t, i in model["vocab"].items()}
    if len(vocab) < len(model["vocab"]):
        return None  # two strings would be spelled alike
    split = {"type": "Split", "pattern": {"Regex": GROUPED}, "behavior": "Isolated", "invert": False}
    return data | {"model": model | {"vocab": vocab, "merges": [[spell(a), spell(b)] for a, b in merges], "byte_fallback": True}, "pre_tokenizer": split, "decoder": None}


_libraries: dict[str, Tokenizer] = {}


def library(path: str) -> Tokenizer:
    """The tokenizer of this process: the file's, grouped where that is proven to give the same ids."""
    if path not in _libraries:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        with open(path, encoding="utf-8") as f:
            data = grouped(json.load(f))
        _libraries[path] = Tokenizer.from_str(json.dumps(data)) if data else Tokenizer.from_file(path)
    return _libraries[path]


# ---------------------------------------------------------------- writing and reading

#: Bytes of records that a task reads at once; characters of text that the library gets at once.
BLOCK, CHARACTERS = 8 << 20, 1 << 18


def encode(texts: list[str], tokenizer: Tokenizer) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all whole texts in a row, by the library, and len(texts) + 1 bounds."""
    ids, sizes, at = array("I"), [0], 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= CHARACTERS):
            size += len(texts[end])
            end += 1
        for e in tokenizer.encode_batch_fast(texts[at:end], add_special_tokens=False):
            ids.fromlist(own := e.ids)
            sizes.append(len(own))
        at = end
    return np.array(ids, np.uint32), np.cumsum(sizes)


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def write_records(docs: DataFrame, vocabulary: str, path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode docs and write records in ascending id order below path; returns the offset index.

    Files part-NNNNN.rec follow each other in id order. The index, a table below path/index, has a row per record:
    (part, id, offset, size, first, n_tokens, width), first being the tokens before it in its file. A task writes
    under a name of its own and then renames, so a repeated task leaves one whole file. Null ids come last; equal ids
    come in the order of a hash of their texts, so that one id's rows may fill several files.
    """
    spark = docs.sparkSession
    n = shared.partitions(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    part, count = shared.range_parts(rows, "id", shared.tie(F.col("text")), n)
    rows = rows.withColumn("part", part).repartitionById(count, F.col("part")).sortWithinPartitions("part", F.col("id").asc_nulls_last(), shared.tie(F.col("text")), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = library(vocabulary)
        width = 2 if max(tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        files, folder = _open(path)
        files.create_dir(folder, recursive=True)
        out, part, own, at, first = None, None, "", 0, 0

        def close() -> None:
            if out is not None:
                out.close()
                files.move(own, f"{folder}/part-{part:05d}.rec")

        for batch in batches:
            parts = batch.column(2).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)] if len(parts) else [0]
            for a, b in zip(edges[:-1], edges[1:]):
                if part != int(parts[a]):
                    close()
                    part, at, first = int(parts[a]), 0, 0
                    own = f"{folder}/part-{part:05d}.{uuid.uuid4().hex}"
                    out = files.open_output_stream(own)
                ids, bounds = encode(texts_of(batch.column(1).slice(a, b - a)), tokenizer)
                ids = np.insert(ids, bounds[1:], end_id).astype(f"<u{width}")
                tokens = np.diff(bounds) + 1
                data, begins = frame(ids.view(np.uint8), tokens * width)
                out.write(data)
                firsts = first + np.cumsum(tokens) - tokens
                columns = [parts[a:b], batch.column(0).slice(a, b - a), at + begins, tokens * width, firsts, tokens, np.full(b - a, width)]
                kinds = [pa.int32(), None, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
                yield pa.RecordBatch.from_arrays([c if k is None else pa.array(c.astype(k.to_pandas_dtype())) for c, k in zip(columns, kinds)], names=["part", "id", "offset", "size", "first", "n_tokens", "width"])
                at, first = at + len(data), first + int(tokens.sum())
        close()

    rows.select("id", "text", F.col("part").cast("int").alias("part")).mapInArrow(run, f"part int, id {kind}, offset long, size long, first long, n_tokens long, width int").write.parquet(f"{path}/index")
    return spark.read.parquet(f"{path}/index")


def read_records(index: DataFrame, path: str, result: Callable[[np.ndarray, np.ndarray], dict[str, pa.Array]], schema: str) -> DataFrame:
    """Read the records of the index's rows, in any order, and turn each group of them into columns.

    result(ids, bounds) gets the ids of a group of records in a row with their bounds. The index's columns part, id,
    first and n_tokens come before the result's columns, named in schema. Rows that follow each other in a file are
    read together; a damaged record raises an error.
    """
    kind = index.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = _open(path)
        name, source = None, None
        for batch in batches:
            part, offset, size, width = (batch.column(i).to_numpy() for i in (0, 2, 3, 6))
            whole = size + HEAD + TAIL
            a = 0
            while a < len(part):
                b = a + 1
                while b < len(part) and part[b] == part[a] and offset[b] == offset[b - 1] + whole[b - 1] and offset[b] + whole[b] - offset[a] <= BLOCK:
                    b += 1
                if name != (name := f"{folder}/part-{part[a]:05d}.rec"):
                    source = files.open_input_file(name)
                data = np.frombuffer(source.read_at(int(offset[b - 1] + whole[b - 1] - offset[a]), int(offset[a])), np.uint8)
                starts, ends = unframe(data, offset[a:b] - offset[a], size[a:b], name)
                n = size[a:b]
                raw = np.empty(int(n.sum()), np.uint8)
                _copy(raw, np.cumsum(n) - n, data, starts, ends)
                ids = raw.view(f"<u{width[a]}")
                extra = result(ids, np.concatenate([[0], np.cumsum(n // width[a])]))
                kept = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), kept.column(4), kept.column(5), *extra.values()], names=["part", "id", "first", "n_tokens", *extra])
                a = b

    return index.select("part", "id", "offset", "size", "first", "n_tokens", "width").mapInArrow(run, f"part int, id {kind}, first long, n_tokens long, {schema}")


def _crc(ids: np.ndarray, bounds: np.ndarray) -> dict[str, pa.Array]:
    raw, at = memoryview(ids.astype("<u4").tobytes()), bounds.tolist()
    return {"ids_crc32": pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:])], pa.int64())}


def token_records(docs: DataFrame, vocabulary: str, end_id: int = 0, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write docs as records, read them back: (id, start, n_tokens, ids_crc32) (operator 5).

    start counts the ids of all documents before in ascending id order, null ids last, equal ids by a hash of the text. A
    null or empty text is the end id alone. Repeated rows are records each; other columns are not read; an empty table makes
    no records. Special strings in texts count as the library's default has it.
    """
    path = path or shared.folder(docs.sparkSession)
    index = write_records(docs, vocabulary, path, end_id, id_col, text_col)
    # one row per file; each file's base is the tokens of the files before it
    parts = index.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    sizes = sorted((r["part"], r["n"]) for r in parts.collect())  # as many rows as partitions were written
    base, total = [], 0
    for p, n in sizes:
        base.append((p, total))
        total += n
    spark = docs.sparkSession
    bases = F.broadcast(spark.createDataFrame(base, "part int, base long"))
    back = read_records(index, path, _crc, "ids_crc32 long")
    return back.join(bases, "part").select(F.col("id").alias(id_col), (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")
