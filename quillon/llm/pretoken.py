"""Vectorised pre-tokenisation for byte-level BPE, and a bounded memo from pre-tokens to token ids.

Texts are laid out as code points in one array with a sentinel between them, so the splitting
pattern of the public vocabularies becomes a few comparisons of neighbouring character classes.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Sequence

import numpy as np
import regex
from tokenizers import pre_tokenizers

#: Stands between texts; no code point has it.
SEP = 0x110000
OTHER, LETTER, NUMBER, SPACE, EDGE = range(5)
#: Unicode White_Space (fixed values).
WHITE_SPACE = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: Code points that are split off in one piece; longer texts are cut where the pattern always cuts.
CHUNK = 1 << 19
_CUT = re.compile("[A-Za-z] [A-Za-z]")


def _classes() -> np.ndarray:
    """Class of every code point as the tokenizer libraries see it.

    The regex module and unicodedata know different Unicode versions; where they disagree about an
    assigned letter or number, the tokenizers library itself is asked.
    """
    table = np.zeros(SEP + 1, np.uint8)
    points = [c for c in range(SEP) if not 0xD800 <= c < 0xE000]
    text = "".join(map(chr, points))
    at = np.array(points, np.int64)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, text):
            table[at[m.start() : m.end()]] = kind
    table[list(WHITE_SPACE)] = SPACE
    ask = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    for c in np.flatnonzero((table == LETTER) | (table == NUMBER)):
        if unicodedata.category(s := chr(c)) == "Cn":
            table[c] = LETTER if len(ask(f"a{s}a")) == 1 else NUMBER if len(ask(f"1{s}1")) == 1 else OTHER
    table[SEP] = EDGE
    return table


_state: dict[str, np.ndarray] = {}


def classes() -> np.ndarray:
    """The class table, built once a process."""
    if "classes" not in _state:
        _state["classes"] = _classes()
    return _state["classes"]


def cut(text: str, most: int = CHUNK) -> Iterable[str]:
    """Pieces of about `most` characters, cut only before a space between two letters."""
    at = 0
    while len(text) - at > 2 * most and (m := _CUT.search(text, at + most)):
        yield text[at : m.start() + 1]
        at = m.start() + 1
    yield text[at:] if at else text


def layout(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points with SEP before each text and four after the last; where each text begins."""
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.cumsum(n + 1) - n
    points = np.full(int(n.sum()) + len(texts) + 4, SEP, np.uint32)
    for t, b, k in zip(texts, begins.tolist(), n.tolist()):
        points[b : b + k] = np.frombuffer(t.encode("utf-32-le"), np.uint32)
    return points, begins


def split(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pre-tokens in a layout."""
    kind = classes()[points]
    white = kind == SPACE
    start = np.zeros(len(points), bool)
    start[1:] = kind[1:] != kind[:-1]
    start &= kind != EDGE
    last = white[:-1] & (kind[1:] < SPACE)  # the last white space before a word
    start[:-1] |= last
    start[1:] &= ~(last & (points[:-1] == 32))  # a space goes with the word after it
    for a in (np.flatnonzero(start[:-3] & (points[:-3] == 39)),):  # contractions
        one, two = points[a + 1], points[a + 2]
        n = np.where(np.isin(one, [ord(c) for c in "stmd"]), 2, 0)
        for x, y in ("re", "ve", "ll"):
            n[(one == ord(x)) & (two == ord(y))] = 3
        a, n = a[n > 0], n[n > 0]
        start[a + 1] = False
        start[a + n] = kind[a + n] != EDGE
    edge = np.flatnonzero(start | (kind == EDGE))
    real = start[edge[:-1]]
    return edge[:-1][real], edge[1:][real]


_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= _M2
    x ^= x >> np.uint64(27)
    x *= _M3
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    """The first n powers of an odd multiplier modulo 2**64."""
    if len(_state.get("powers", ())) < n:
        p = np.full(max(n, 4096), _M1)
        p[0] = 1
        _state["powers"] = np.multiply.accumulate(p)
    return _state["powers"]


def hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each slice; never 0. Slices are in order and don't overlap."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    n = ends - starts
    inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    slot = inside + np.repeat(starts, n)
    x = mix(points[slot] + np.uint32(1)) * powers(int(n.max()))[inside]
    return mix(np.add.reduceat(x, np.cumsum(n) - n) + n.astype(np.uint64)) | np.uint64(1)


def _grown(x: np.ndarray, size: int) -> np.ndarray:
    """x with room for `size` elements, doubled as often as that takes."""
    if size <= len(x):
        return x
    out = np.zeros(max(size, 2 * len(x)), x.dtype)
    out[: len(x)] = x
    return out


class Memo:
    """Token ids of pre-tokens, in two tiers.

    The first tier is fixed: a perfect hash of strings whose ids are known. Other pre-tokens are resolved once each and
    kept in open addressing, which is emptied when it holds `cap` of them. In both tiers a 64-bit hash only finds an
    entry; the entry's characters are compared with the pre-token's, and pre-tokens that share a hash have entries each.
    """

    def __init__(self, resolve: Callable[[list[str]], list[Sequence[int]]], cap: int = 1 << 20, first: PerfectHash | None = None, first_ids: Sequence[int] = ()):
        self.resolve, self.cap, self.first = resolve, cap, first
        self.n = self.used = self.spelt = 0
        self.counts, self.sizes, self.offsets, self.places = np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.ids, self.points = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.uint32)
        if first is not None:
            self._append(first.keys, [(i,) for i in first_ids])
        self.fixed = (self.n, self.used, self.spelt)
        self.clear()

    def clear(self) -> None:
        self.n, self.used, self.spelt = self.fixed
        self.bits = 16
        self.keys, self.vals = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        self.hashed: list[tuple[np.ndarray, np.ndarray]] = []
        self.clash: dict[str, int] = {}  # pre-tokens whose hash another one has

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Entry that a hash leads to, or -1."""
        mask, slot = np.int64((1 << self.bits) - 1), (h >> np.uint64(64 - self.bits)).astype(np.int64)
        out, at = np.full(len(h), -1, np.int32), np.arange(len(h))
        while len(at):
            k = self.keys[slot]
            hit = k == h[at]
            out[at[hit]] = self.vals[slot[hit]]
            on = ~hit & (k != 0)
            at, slot = at[on], (slot[on] + 1) & mask
        return out

    def _put(self, h: np.ndarray, v: np.ndarray) -> None:
        mask, slot = np.int64((1 << self.bits) - 1), (h >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(h):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[free]
            own = free & (self.keys[slot] == h)
            self.vals[slot[own]] = v[own]
            h, v, slot = h[~own], v[~own], (slot[~own] + 1) & mask

    def _append(self, words: Sequence[str], found: Sequence[Sequence[int]]) -> np.ndarray:
        """New entries: their numbers."""
        counts, sizes = np.fromiter(map(len, found), np.int64, len(words)), np.fromiter(map(len, words), np.int64, len(words))
        total, spelt, n = int(counts.sum()), int(sizes.sum()), self.n + len(words)
        self.counts, self.sizes, self.offsets, self.places = (_grown(x, n) for x in (self.counts, self.sizes, self.offsets, self.places))
        self.ids, self.points = _grown(self.ids, self.used + total), _grown(self.points, self.spelt + spelt)
        self.ids[self.used : self.used + total] = np.fromiter((i for x in found for i in x), np.uint32, total)
        self.points[self.spelt : self.spelt + spelt] = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        new = np.arange(self.n, n)
        self.counts[new], self.sizes[new] = counts, sizes
        self.offsets[new], self.places[new] = self.used + np.cumsum(counts) - counts, self.spelt + np.cumsum(sizes) - sizes
        self.n, self.used, self.spelt = n, self.used + total, self.spelt + spelt
        return new.astype(np.int32)

    def _add(self, h: np.ndarray, words: list[str]) -> None:
        self.hashed.append((h, self._append(words, self.resolve(words))))
        if (self.n - self.fixed[0]) * 5 > 2 << self.bits:
            self.bits = int(self.n - self.fixed[0]).bit_length() + 2
            self.keys, self.vals = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
            self._put(*(np.concatenate(x) for x in zip(*self.hashed)))
        else:
            self._put(*self.hashed[-1])

    def _same(self, entry: np.ndarray, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """entry where its characters are those of the slice, else -1."""
        n, out = ends - starts, entry.copy()
        out[(entry >= 0) & (self.sizes[entry] != n)] = -1
        some = np.flatnonzero(out >= 0)
        if len(some):
            n, at = n[some], np.cumsum(n[some]) - n[some]
            inside = np.arange(int(n.sum())) - np.repeat(at, n)
            equal = points[inside + np.repeat(starts[some], n)] == self.points[inside + np.repeat(self.places[out[some]], n)]
            out[some[~np.logical_and.reduceat(equal, at)]] = -1
        return out

    def entries(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Entry of each pre-token: by the first tier, else by the second."""
        h = hashes(points, starts, ends)
        if self.first is None:
            return self._second(points, starts, ends, h)
        out = self._same(self.first.lookup(h), points, starts, ends)
        miss = np.flatnonzero(out < 0)
        if len(miss):
            out[miss] = self._second(points, starts[miss], ends[miss], h[miss])
        return out

    def _second(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> np.ndarray:
        word = lambda k: points[starts[k] : ends[k]].tobytes().decode("utf-32-le")
        found = self._find(h)
        miss = np.flatnonzero(found < 0)
        if len(miss):
            new, first = np.unique(h[miss], return_index=True)
            if self.n > self.fixed[0] and self.n - self.fixed[0] + len(new) > self.cap:
                self.clear()
                return self._second(points, starts, ends, h)
            self._add(new, [word(k) for k in miss[first].tolist()])
            found[miss] = self._find(h[miss])
        out = self._same(found, points, starts, ends)
        for k in np.flatnonzero(out < 0).tolist():
            w = word(k)
            if w not in self.clash:
                self.clash[w] = int(self._append([w], self.resolve([w]))[0])
            out[k] = self.clash[w]
        return out


def hash_strings(keys: Sequence[str]) -> np.ndarray:
    """The same hashes for strings."""
    n = np.fromiter(map(len, keys), np.int64, len(keys))
    ends = np.cumsum(n)
    return hashes(np.frombuffer("".join(keys).encode("utf-32-le"), np.uint32), ends - n, ends)


class PerfectHash:
    """Minimal perfect hash of distinct, not empty strings by hash and displace: a key's bucket names the displacement
    that sends all keys of the bucket to free slots. Strangers get some slot too, so whoever looks up compares the key."""

    def __init__(self, keys: Sequence[str], load: int = 4):
        self.size, self.buckets = len(keys), max(1, len(keys) // load)
        self.shift = np.zeros(self.buckets, np.int64)
        self.slots = np.full(self.size, -1, np.int32)
        self.keys = list(keys)
        if not keys:
            return
        h = mix(hash_strings(keys))  # hashes are odd; mixed ones fill all buckets
        if len(np.unique(h)) < len(h):
            raise ValueError("two keys have the same hash, or a key stands twice")
        bucket = (h % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bounds = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        n = np.diff(bounds)
        for b in np.argsort(-n, kind="stable").tolist():  # the fullest first
            own = order[bounds[b] : bounds[b + 1]]
            if len(own) < 2:
                break
            tries = np.arange(256)
            while True:
                s = self._slot(h[own][None, :], tries[:, None])
                good = (self.slots[s] < 0).all(1)
                good[good] = [len(set(x)) == len(own) for x in s[good].tolist()]
                if good.any():
                    first = int(good.argmax())
                    self.slots[s[first]], self.shift[b] = own, tries[first]
                    break
                tries += len(tries)
        single = np.flatnonzero(n == 1)  # a bucket of one key names its slot
        free = np.flatnonzero(self.slots < 0)
        self.slots[free] = order[bounds[single]]
        self.shift[single] = -1 - free

    def _slot(self, h: np.ndarray, d: np.ndarray) -> np.ndarray:
        hashed = mix(h ^ mix(d.astype(np.uint64))) % np.uint64(self.size)
        return np.where(d < 0, -1 - d, hashed.astype(np.int64))

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Number of the only key that may have each hash; -1 without keys."""
        if not self.size:
            return np.full(len(h), -1, np.int32)
        h = mix(h)
        return self.slots[self._slot(h, self.shift[(h % np.uint64(self.buckets)).astype(np.int64)])]

    def find(self, keys: Sequence[str]) -> list[int]:
        """Number of each key, or -1 for strangers."""
        if not keys or not self.size:
            return [-1] * len(keys)
        return [i if self.keys[i] == k else -1 for i, k in zip(self.lookup(hash_strings(keys)).tolist(), keys)]


def chunks(texts: Sequence[str], special: dict[str, int]) -> Iterable[tuple[list[str], list[int], list[tuple[int, int]]]]:
    """Pieces of about CHUNK characters together: (pieces, number of the text of each, specials).

    A special string cuts a text; specials has (piece index, id) of those that stand before a piece.
    """
    pattern = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
    pieces: list[str] = []
    owner: list[int] = []
    marks: list[tuple[int, int]] = []
    size = 0
    for i, text in enumerate(texts):
        for part in pattern.split(text) if pattern and any(s in text for s in special) else (text,):
            if part in special:
                marks.append((len(pieces), special[part]))
                continue
            for piece in cut(part):
                pieces.append(piece)
                owner.append(i)
                size += len(piece) + 1
        if size >= CHUNK:
            yield pieces, owner, marks
            pieces, owner, marks, size = [], [], [], 0
    if pieces:
        yield pieces, owner, marks


def count(texts: Sequence[str], memo: Memo, special: dict[str, int] | None = None) -> np.ndarray:
    """Number of tokens of each text."""
    total = np.zeros(len(texts), np.int64)
    for pieces, owner, marks in chunks(texts, special or {}):
        points, begins = layout(pieces)
        starts, ends = split(points)
        at = memo.entries(points, starts, ends)
        n = memo.counts[at]
        of = np.asarray(owner)[np.searchsorted(begins, starts, "right") - 1]
        total += np.bincount(of, n, len(texts)).astype(np.int64)
        for k, _ in marks:
            total[owner[min(k, len(owner) - 1)]] += 1
    return total


def encode(texts: Sequence[str], memo: Memo, special: dict[str, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all texts in a row, and len(texts) + 1 offsets."""
    parts: list[np.ndarray] = []
    total = np.zeros(len(texts), np.int64)
    for pieces, owner, marks in chunks(texts, special or {}):
        points, begins = layout(pieces)
        starts, ends = split(points)
        at = memo.entries(points, starts, ends)
        n = memo.counts[at].astype(np.int64)
        ids = memo.ids[np.arange(int(n.sum())) + np.repeat(memo.offsets[at] - np.cumsum(n) + n, n)]
        piece = np.searchsorted(begins, starts, "right") - 1
        total += np.bincount(np.asarray(owner)[piece], n, len(texts)).astype(np.int64)
        if marks:
            ends_of = np.cumsum(np.bincount(piece, n, len(pieces)).astype(np.int64))
            before = np.concatenate([[0], ends_of])
            ids = np.insert(ids, [before[k] for k, _ in marks], [x for _, x in marks])
            for k, _ in marks:
                total[owner[min(k, len(owner) - 1)]] += 1
        parts.append(ids)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint32)), np.concatenate([[0], np.cumsum(total)])
