"""Homomorphic multiset hash of documents (operator 7).

A document is the multiset of its paragraphs: its lines, cut further behind words whose hash says so, so that a change
leaves the other paragraphs as they are. Every paragraph hashes to one wide vector; the fingerprint is the sum of the
vectors, each lane modulo a power of two. So order doesn't matter, and a paragraph is inserted or deleted by adding or
subtracting its vector. The lanes of a vector are of two kinds, both taken from the paragraph's 128-bit hash:

- EXACT lanes modulo 2**32, uniform: equal sums mean equal multisets;
- SIGN lanes modulo 2**24, each 1 or -1: the scalar product of two sums estimates how many paragraphs they share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import shared
from quillon.llm.pretoken import mix
from quillon.llm.wordhash import Words

#: Lanes of either kind; a line is cut behind one word in CUT.
EXACT, SIGN, CUT = 16, 256, 8
#: Bytes of text that a task works on together; paragraphs whose signs are laid out at once.
GROUP, BLOCK = 2 << 20, 1 << 13
_EXACT_LANES, _SIGN_LANES = mix(np.arange(1, EXACT + 1)), mix(np.arange(101, 101 + SIGN // 64))


def paragraphs(texts: Sequence[bytes]) -> tuple[list[bytes], np.ndarray]:
    """Paragraphs of all texts in a row, and how many each text has; an empty text has none, an empty line is one.

    Put together, the paragraphs of a line are the line.
    """
    lines = [line for t in texts if t for line in t.split(b"\n")]
    n_lines = np.fromiter((t.count(b"\n") + 1 if t else 0 for t in texts), np.int64, len(texts))
    w = Words(lines)
    of = np.repeat(np.arange(len(lines)), np.diff(w.first))
    last = np.ones(len(of), bool)
    last[:-1] = of[1:] != of[:-1]
    at = np.flatnonzero((w.hash >> np.uint64(13)) % np.uint64(CUT) == 0)
    at = at[~last[at]]
    line, end = of[at].tolist(), (w.ends[at] - w.begins[of[at]]).tolist()
    out: list[bytes] = []
    n = np.ones(len(lines), np.int64) + np.bincount(of[at], minlength=len(lines)) if len(lines) else np.zeros(0, np.int64)
    k = 0
    for i, text in enumerate(lines):
        start = 0
        while k < len(line) and line[k] == i:
            out.append(text[start : end[k]])
            start = end[k]
            k += 1
        out.append(text[start:])
    total = np.concatenate([[0], np.cumsum(n)])
    ends = np.cumsum(n_lines)
    return out, total[ends] - total[ends - n_lines]


def vectors(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Exact (uint32) and sign (int64, from -2**23 to 2**23 - 1) lanes of each text; an empty text's are all 0."""
    flat, n = paragraphs(texts)
    h = np.frombuffer(b"".join(xxhash.xxh3_128_digest(p) for p in flat), "<u8").reshape(-1, 2)
    ends = np.cumsum(n)
    of = np.repeat(np.arange(len(texts)), n)
    exact, sign = np.zeros((len(texts), EXACT), np.uint64), np.zeros((len(texts), SIGN), np.int64)
    for a in range(0, len(flat), BLOCK):
        part, text = h[a : a + BLOCK], of[a : a + BLOCK]
        first = np.flatnonzero(np.diff(text, prepend=-1))
        exact[text[first]] += np.add.reduceat((mix(part[:, :1] ^ _EXACT_LANES) + mix(part[:, 1:] + _EXACT_LANES)) >> np.uint64(32), first)
        bits = np.unpackbits(np.ascontiguousarray(mix(part[:, :1] + _SIGN_LANES) ^ mix(part[:, 1:] ^ _SIGN_LANES)).view(np.uint8), axis=1)
        size = np.diff(np.append(first, len(text)))
        sign[text[first]] += 2 * np.add.reduceat(bits, first, dtype=np.int64) - size[:, None]
    return exact.astype(np.uint32), _wrapped(sign)


def _wrapped(sign: np.ndarray) -> np.ndarray:
    """Lanes modulo 2**24, from -2**23 on."""
    return (sign + (1 << 23)) % (1 << 24) - (1 << 23)


def digest(exact: np.ndarray, sign: np.ndarray) -> str:
    """A fingerprint as lowercase hex: four bytes for each exact lane, three for each sign lane."""
    low = np.ascontiguousarray(sign.astype("<i4")).view(np.uint8).reshape(-1, 4)[:, :3]
    return (exact.astype("<u4").tobytes() + low.tobytes()).hex()


def parse(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Lanes of a fingerprint."""
    raw = bytes.fromhex(text)
    low = np.frombuffer(raw[4 * EXACT :], np.uint8).reshape(-1, 3).astype(np.int64)
    return np.frombuffer(raw[: 4 * EXACT], "<u4"), _wrapped(low[:, 0] | low[:, 1] << 8 | low[:, 2] << 16)


def insert(fingerprint: str, lines: Sequence[str]) -> str:
    """Fingerprint with more lines."""
    return _moved(fingerprint, lines, 1)


def delete(fingerprint: str, lines: Sequence[str]) -> str:
    """Fingerprint without some of its lines."""
    return _moved(fingerprint, lines, -1)


def _moved(fingerprint: str, lines: Sequence[str], by: int) -> str:
    exact, sign = parse(fingerprint)
    e, r = vectors([b"\n".join(x.encode() for x in lines)] if list(lines) != [""] else [b"\n"])
    if list(lines) == [""]:  # two empty lines are one more than asked
        a, b = vectors([b"x\n"]), vectors([b"x"])
        e, r = a[0] - b[0], a[1] - b[1]
    elif not lines:
        return fingerprint
    return digest(exact + e[0], _wrapped(sign + r[0])) if by > 0 else digest(exact - e[0], _wrapped(sign - r[0]))


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """About the share of paragraphs that documents have in common, 0 to 1, by rows; 1 for equal fingerprints.

    2 <a, b> / (<a, a> + <b, b>) of the sign lanes, off by about 1 / sqrt(SIGN).
    """
    same = (a[0] == b[0]).all(1) & (a[1] == b[1]).all(1)
    x, y = a[1].astype(np.float64), b[1].astype(np.float64)
    size = (x * x).sum(1) + (y * y).sum(1)
    return np.where(same, 1.0, np.clip(np.divide(2 * (x * y).sum(1), size, out=np.zeros(len(x)), where=size > 0), 0, 1))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of every document, and of its text after an edit (operator 7): (id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next).

    The edit puts the first floor(n_chars / 3) code points of the next document, or all it has, in place of as many
    at the end. Next is the next smaller id, null ids last, equal ids by a hash of the text, then the text; after the
    last comes the first, so a lone document follows itself. A null text is empty, with all lanes 0. A line repeated more
    than 2**23 times wraps around in the likeness. Repeated rows are rows of their own; other columns, of any name, are
    not read; an empty table gives no rows.

    One range shuffle: each part also gets the first document of the part after it, so that all neighbours meet.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", shared.tie(F.col("text")))
    part, count = shared.range_parts(rows, "id", F.col("tie"), shared.partitions(spark), nulls_last=False)
    rows = rows.withColumn("part", part)
    first = F.struct(F.col("id").isNotNull().alias("known"), "id", "tie")
    heads = rows.groupBy("part").agg(F.max(first).alias("head")).orderBy(F.col("part").desc()).collect()  # a row a part
    to = [(h["part"], h["head"]["id"], h["head"]["tie"], heads[i - 1]["part"]) for i, h in enumerate(heads)]  # the first goes to the last
    ghosts = F.broadcast(spark.createDataFrame(to, f"p int, head {kind}, head_tie double, to int"))
    ghost = rows.join(ghosts, (F.col("part") == F.col("p")) & F.col("id").eqNullSafe(F.col("head")) & (F.col("tie") == F.col("head_tie")))
    both = rows.select("id", "text", "part", F.lit(False).alias("ghost"), "tie").union(ghost.select("id", "text", "to", F.lit(True), "tie"))
    dealt = both.repartitionById(count, F.col("part")).sortWithinPartitions("part", "ghost", F.col("id").desc_nulls_last(), F.col("tie").desc(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # documents of a part in order; the last waits for its next
        ids: list[pa.DataType] = []

        def ready() -> pa.RecordBatch:
            texts = [t for _, t in held]
            edited = [t[: len(t) - len(t) // 3] + u[: len(t) // 3] for t, u in zip(texts[:-1], texts[1:])]
            raw, changed = [t.encode() for t in texts], [t.encode() for t in edited]
            f, g = vectors(raw), vectors(changed)
            mine, after = tuple(x[:-1] for x in f), tuple(x[1:] for x in f)
            columns = [
                pa.array([i for i, _ in held[:-1]], ids[0]), pa.array([len(t) for t in texts[:-1]], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in changed], pa.string()),
                pa.array([digest(*x) for x in zip(*mine)], pa.string()), pa.array([digest(*x) for x in zip(*g)], pa.string()), pa.array(likeness(mine, g)), pa.array(likeness(mine, after)),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        part, size = None, 0
        for batch in batches:
            ids[:] = [batch.schema.field(0).type]
            for key, text, p, is_ghost in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if p != part:
                    part, held, size = p, [], 0
                if is_ghost and not held:
                    continue  # a second row with the head's id
                held.append((key, text))
                size += len(text)
                if is_ghost or size >= GROUP and len(held) > 1:
                    yield ready()
                    held, size = ([], 0) if is_ghost else (held[-1:], len(text))

    names = f"id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.drop("tie").mapInArrow(run, names).withColumnRenamed("id", id_col)
