"""Hashes of words and of runs of words over many texts at once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

from quillon.llm.pretoken import hashes, mix

#: Words are runs of bytes other than these; A-Z counts as a-z.
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes that are worked on together.
CHUNK = 1 << 20


def chunks(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive UTF-8 texts of an Arrow column, about CHUNK bytes together: (number of the first, texts)."""
    first, texts, size = 0, [], 0
    for i, x in enumerate(column.to_pylist()):
        texts.append(x.encode() if isinstance(x, str) else x or b"")
        size += len(texts[-1])
        if size >= CHUNK:
            yield first, texts
            first, texts, size = i + 1, [], 0
    if texts:
        yield first, texts


class Words:
    """The words of some texts: their hashes in a row, byte ranges, and where each text's words begin."""

    def __init__(self, texts: Iterable[bytes]):
        texts = list(texts)
        data = np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)
        n = np.fromiter(map(len, texts), np.int64, len(texts))
        begins = np.cumsum(n + 1) - n
        word = ~_GAP[data]
        edge = np.flatnonzero(word[1:] != word[:-1]) + 1
        self.starts, self.ends = edge[::2], edge[1::2]
        self.data = _LOWER[data]
        self.hash = hashes(self.data.astype(np.uint32), self.starts, self.ends)
        #: words of text i are first[i] to first[i + 1]
        self.first = np.searchsorted(self.starts, np.append(begins, len(data)))
        self.begins = begins

    def spelt(self) -> pa.Array:
        """The words themselves, lower-cased, each with one space after it."""
        n = self.ends - self.starts + 1
        offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
        out = self.data[np.arange(int(n.sum())) - np.repeat(offsets[:-1] - self.starts, n)]
        out[offsets[1:] - 1] = 32
        return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(out.tobytes())])

    def runs(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash of the k words from each word on, whether they end within the text)."""
        n = len(self.hash)
        count = max(0, n - k + 1)
        h = np.full(count, np.uint64(k))
        for j in range(k):
            h = h * np.uint64(0x9E3779B97F4A7C15) + self.hash[j : j + count]
        inside = np.zeros(n, bool)
        last = np.repeat(self.first[1:], np.diff(self.first))
        inside[:] = np.arange(n) + k <= last
        out = np.zeros(n, np.uint64)
        out[:count] = mix(h)
        return out, inside


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's k-word shingles; a text with fewer words is one shingle, without words none.

    Two shingles of a set share a hash with a chance of about (size of the set)**2 / 2**65.
    """
    w = Words(texts)
    h, inside = w.runs(k)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(h[a : b - k + 1]))
        elif b > a:
            x = np.uint64(b - a)
            for y in w.hash[a:b]:
                x = mix(np.array([x]) * np.uint64(0x9E3779B97F4A7C15) + y)[0]
            out.append(np.array([x], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
