"""Toxicity by a subsequence string kernel with Nyström landmarks and a linear SVM (operator 4).

The kernel of two strings sums, over all sequences of four letters, the products of their weights in either, where an
occurrence weighs DECAY for each letter it skips and may skip two. Marks and digits are dropped first, so "st.u*pid"
and "stxupid" stay close to the plain word. A window of WINDOW starting letters
is mapped to its kernels with the landmarks, whitened (Nyström), and an SVM separates the windows. As the kernel is a
product of explicit, sparse weights, landmarks and SVM collapse to one table of weights by four letters, with which a
whole text is scored in one pass: by its worst window, by what all bad windows weigh together, and by its length.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm import shared
from quillon.llm.bpe import texts_of

#: a to z are 1 to 26, other letters 27 to 31; white space is 0 and stands in no sequence.
BASE, DROP = 32, 255
DECAY, WINDOW, PAD = 0.6, 8, 16
#: (gap letters, offsets of the second, third and fourth letter)
SHAPES = [(d - 3, b, c, d) for d in range(3, 6) for c in range(2, d) for b in range(1, c)]
#: Most labelled documents of either class that a model is fitted on, landmarks of either kind, negative windows, and most
#: characters of either class's documents together: the sample ends before the document that would pass it. Texts are whole.
PER_CLASS, LANDMARKS, NEGATIVES, SAMPLE_CHARS = 1500, 96, 20000, 24_000_000
CHUNK = 1 << 20

_tables: dict[str, np.ndarray] = {}


def _codes() -> np.ndarray:
    """Code of each code point."""
    if "codes" not in _tables:
        table = np.full(0x110000, DROP, np.uint8)
        for c in range(0x110000):
            if 0xD800 <= c < 0xE000:
                continue
            s = chr(c)
            if s.isspace():
                table[c] = 0
            elif s.isalpha():
                low = ord(s.lower()[0])
                table[c] = low - 96 if 97 <= low <= 122 else 27 + low % 5
        _tables["codes"] = table
    return _tables["codes"]


def letters(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the texts in a row, PAD zeros after each, and where each begins."""
    space = " " * PAD
    joined = space.join(texts) + space
    codes = _codes()[np.frombuffer(joined.encode("utf-32-le"), np.uint32)]
    n = np.fromiter(map(len, texts), np.int64, len(texts)) + PAD
    keep = codes != DROP
    begins = np.concatenate([[0], np.cumsum(keep)])[np.cumsum(n) - n]
    return codes[keep], begins


def _in_blocks(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """The same as letters(), for many texts: only a block of them is wide at a time."""
    block = np.cumsum([len(t) + PAD for t in texts]) // CHUNK if len(texts) else np.zeros(0, np.int64)
    edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(texts)]
    codes, begins, size = [], [], 0
    for x, y in zip(edges[:-1], edges[1:]):
        a, b = letters(texts[x:y])
        codes.append(a)
        begins.append(b + size)
        size += len(a)
    return np.concatenate(codes), np.concatenate(begins)


def _pairs(a: np.ndarray) -> list[np.ndarray]:
    """By distance d: codes of the letter pairs (i, i + d)."""
    wide = a.astype(np.int32)
    out = [wide]
    for d in range(1, 6):
        p = wide * BASE
        p[:-d] += wide[d:]
        p[-d:] = 0
        out.append(p)
    return out


def sequences(a: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(gap, code of the four letters at each start) by shape; a code with a zero digit counts for nothing."""
    pairs = _pairs(a)
    for gap, b, c, d in SHAPES:
        code = pairs[b] * (BASE * BASE)
        code[: len(a) - c] += pairs[d - c][c:]
        code[len(a) - c :] = 0
        yield gap, code


def starts(a: np.ndarray, v: np.ndarray) -> np.ndarray:
    """What the sequences that start at each letter weigh together."""
    by_gap = [np.zeros(len(a), np.float32) for _ in range(3)]
    for gap, code in sequences(a):
        by_gap[gap] += v.take(code, mode="clip")
    return by_gap[0] + np.float32(DECAY) * by_gap[1] + np.float32(DECAY**2) * by_gap[2]


def windows(a: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Weight of the window that starts at each letter. A window that runs into the next text meets only padding."""
    total = np.concatenate([[0.0], np.cumsum(starts(a, v), dtype=np.float64)])
    end = np.minimum(np.arange(len(a)) + WINDOW, len(a))
    return total[end] - total[:-1]


def _valid(code: np.ndarray) -> np.ndarray:
    return (code % BASE > 0) & (code // BASE % BASE > 0) & (code // BASE**2 % BASE > 0) & (code // BASE**3 > 0)


def profile(word: str) -> dict[int, float]:
    """Weights of a string's four-letter sequences."""
    a, _ = letters([word])
    out: Counter = Counter()
    for gap, code in sequences(a):
        for c in code[_valid(code)].tolist():
            out[c] += DECAY**gap
    return dict(out)


@dataclass
class Model:
    """Weights by four letters, and the logistic curve over what a text's windows say."""

    weights: np.ndarray
    curve: np.ndarray

    def evidence(self, texts: Sequence[str]) -> np.ndarray:
        """By text: its worst window, the logarithm of its bad windows' weight, and of its length, and 1."""
        out, at = np.zeros((len(texts), 4)), 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= CHUNK):
                size += len(texts[end])
                end += 1
            a, begins = letters(texts[at:end])
            s = windows(a, self.weights)
            out[at:end, 0] = np.maximum.reduceat(s, begins)
            out[at:end, 1] = np.log1p(np.add.reduceat(np.maximum(s - 1, 0), begins))
            out[at:end, 2] = np.log1p(np.diff(np.append(begins, len(a))) - PAD)
            at = end
        out[:, 3] = 1
        return out

    def scores(self, texts: Sequence[str]) -> np.ndarray:
        """Score of each text, 0 to 1."""
        return 1 / (1 + np.exp(-np.clip(self.evidence(texts) @ self.curve, -30, 30)))


def _svm(z: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss by Newton's method; the last coefficient is the offset."""
    x = np.concatenate([z, np.ones((len(z), 1), np.float32)], 1)
    w = np.zeros(x.shape[1])
    penalty = np.diag([ridge] * z.shape[1] + [1e-3])
    for _ in range(30):
        on = y * (x @ w) < 1
        xo = x[on]
        xw = xo * weight[on, None].astype(np.float32)
        new = np.linalg.solve(penalty + xw.T @ xo, xw.T @ y[on])
        done = np.abs(new - w).max() < 1e-6
        w = new
        if done:
            break
    return w[:-1], w[-1]


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Coefficients of a lightly damped logistic regression."""
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], 1e-2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w = w + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(texts: Sequence[str], labels: Sequence[int], seed: int = 5) -> Model:
    """A model from labelled documents. Without documents of both classes all texts get the share of label 1."""
    y = np.asarray(labels, np.int64)
    none = np.zeros(BASE**4, np.float32)
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.0, 1e-6, 1 - 1e-6))
        return Model(none, np.array([0, 0, 0, np.log(share / (1 - share))]))
    rng = np.random.default_rng(seed)
    # landmarks: words that tell the classes apart, and words of any kind
    seen = [Counter(), Counter()]
    for t, label in zip(texts, y.tolist()):
        ws = {"".join(c for c in w if c.isalpha()) for w in t.lower().split()}
        seen[label].update(w for w in ws if 3 < len(w) < 16)
    n1, n0 = int(y.sum()), int((1 - y).sum())
    words = sorted(seen[1])
    tell = {w: (seen[1][w] / n1 - seen[0][w] / n0) / np.sqrt((seen[1][w] + seen[0][w] + 1) / (n1 + n0)) for w in words}
    marked: list[str] = []
    near: dict[int, set[int]] = {}  # the landmarks so far that have a sequence
    size: list[float] = []
    for w in sorted(words, key=lambda w: (-tell[w], w))[: 50 * LANDMARKS]:
        p = profile(w)
        like = Counter(i for c in p for i in near.get(c, ()))
        if not p or any(2 * n > min(len(p), size[i]) for i, n in like.items()):
            continue  # much the same as a landmark that tells more
        for c in p:
            near.setdefault(c, set()).add(len(marked))
        marked.append(w)
        size.append(len(p))
        if len(marked) == LANDMARKS:
            break
    plain = sorted(set(seen[0]) - set(marked))
    landmarks = marked + [plain[i] for i in sorted(rng.choice(len(plain), min(2 * LANDMARKS, len(plain)), replace=False).tolist())]
    del seen, plain
    profiles = [p for p in map(profile, landmarks) if p]
    if not profiles:
        return Model(none, np.array([0, 0, 0, np.log(n1 / n0)]))
    columns = {c: i for i, c in enumerate(sorted(set().union(*profiles)))}
    f = np.zeros((len(profiles), len(columns)))
    for i, p in enumerate(profiles):
        f[i, [columns[c] for c in p]] = list(p.values())
    value, vector = np.linalg.eigh(f @ f.T)
    good = value > 1e-6 * value.max()
    nystrom = (vector[:, good] / np.sqrt(value[good])).T @ f  # sparse weights of a string -> its Nyström features
    index = np.full(BASE**4, len(columns))
    index[list(columns)] = np.arange(len(columns))
    nystrom = np.concatenate([nystrom, np.zeros((len(nystrom), 1))], 1)

    def features(a: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Nyström features of the windows that start at the places `at`, laid out apart from each other."""
        span = WINDOW + 5
        apart = np.zeros((len(at), span + PAD), np.uint8)
        apart[:, :span] = a[np.minimum(at[:, None] + np.arange(span), len(a) - 1)]
        z = np.zeros((len(at), len(nystrom)), np.float32)
        for gap, code in sequences(apart.ravel()):
            u = index[code].reshape(len(at), -1)
            for k in range(WINDOW):
                on = np.flatnonzero(u[:, k] < len(columns))
                z[on] += DECAY**gap * nystrom[:, u[on, k]].T
        return z

    def weights(w: np.ndarray) -> np.ndarray:
        v = none.copy()
        v[list(columns)] = w @ nystrom[:, :-1]
        return v

    # labelled sentences; one that the label of its document doesn't tell apart is left to the rounds below
    sentences, owner = [], []
    for i, t in enumerate(texts):
        for s in t.replace("\n", ".").replace("!", ".").replace("?", ".").split("."):
            if s.strip():
                sentences.append(s)
                owner.append(i)
    owner = np.array(owner)
    a, begins = _in_blocks(sentences)
    start = np.zeros(len(profiles))
    start[: len(marked)] = [tell[w] for w in marked]
    v = none.copy()
    v[list(columns)] = start @ (f / np.square(f).sum(1, keepdims=True))
    for turn in range(4):
        ends = np.append(begins[1:], len(a))
        cuts = [0, *begins[np.flatnonzero(np.diff(begins // CHUNK)) + 1].tolist(), len(a)]
        best, top, i = np.zeros(len(begins), np.int64), np.zeros(len(begins)), 0
        for low, high in zip(cuts[:-1], cuts[1:]):
            s, j = windows(a[low:high], v), int(np.searchsorted(begins, high))
            best[i:j] = [b + int(s[b - low : e - low].argmax()) for b, e in zip(begins[i:j].tolist(), ends[i:j].tolist())]
            top[i:j] = s[best[i:j] - low]
            i = j
        # the witness of a toxic document is its worst sentence; all sentences of the others are harmless
        order = np.lexsort((-top, owner))
        first = order[np.unique(owner[order], return_index=True)[1]]
        witness = first[y[owner[first]] == 1]
        worst = first[y[owner[first]] == 0]
        # later, toxic documents none of whose sentences stands out teach nothing
        floor = np.quantile(top[worst], 0.9) if turn and len(worst) else -np.inf
        witness = witness[top[witness] > floor] if (top[witness] > floor).sum() >= 5 else witness
        others = np.flatnonzero(y[owner] == 0)
        others = np.union1d(worst, rng.choice(others, min(NEGATIVES, len(others)), replace=False)) if len(others) else worst
        places = np.concatenate([best[witness], best[others]])
        z = np.concatenate([features(a, places[k : k + 2048]) for k in range(0, len(places), 2048)])
        target = np.concatenate([np.ones(len(witness)), -np.ones(len(others))])
        balance = np.where(target > 0, 0.5 * len(target) / max(len(witness), 1), 0.5 * len(target) / max(len(others), 1)) / 10
        w, _ = _svm(z, target, balance)
        v = weights(w)
    return Model(v, _logistic(Model(v, np.zeros(4)).evidence(texts), y))


def held_out(id_col: str) -> Column:
    """Rows that no model learns from: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, sample_chars: int = SAMPLE_CHARS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on labelled documents outside the held-out rows: of each class the per_class first by a hash of the id.

    A label counts if it is 0 or 1; of several for an id the largest; ids without a text or label teach nothing. Of rows
    that share an id one teaches, that with the smallest text by hash. Documents teach with their whole texts; of each class
    as many as have sample_chars characters together, in the order of the hash, and one at least. So the sample of labelled rows
    is bounded in rows and in size. An empty table of labels gives a model that scores all alike; columns of any name
    may clash.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    marks = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).alias("__label")).where(~held_out("__id"))
    picked = None
    for label in (0, 1):
        few = marks.where(F.col("__label") == label).orderBy(F.md5(F.col("__id").cast("string")), "__id").limit(per_class)
        picked = few if picked is None else picked.union(few)
    found = docs.join(F.broadcast(picked), F.col("id") == F.col("__id")).groupBy("__id", "__label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text"))
    found = shared.table(found)
    before = Window.partitionBy("__label").orderBy(F.md5(F.col("__id").cast("string")), "__id").rowsBetween(Window.unboundedPreceding, -1)
    sizes = found.select("__id", "__label", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n"))  # at most per_class rows a label
    kept = sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).where((F.col("before") + F.col("n") <= sample_chars) | (F.col("before") == 0)).select("__id")
    rows = found.join(F.broadcast(kept), "__id", "left_semi").toArrow().to_pylist()
    rows.sort(key=lambda r: r["__id"])
    return fit([r["text"] or "" for r in rows], [r["__label"] for r in rows])


def score(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every whole text (operator 4).

    Null and empty texts have no window and get the curve's value there. Rows, also repeated ones, stay; a null id isn't
    held out; other columns are not read; an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = sent.value.scores(texts_of(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)


def harmless(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of docs that score below the threshold, with all their columns, of any names; null and empty texts have the
    score of an empty text, repeated rows stay or go together, texts are read whole, an empty table gives no rows."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = sent.value.scores(texts_of(batch.column(batch.schema.get_field_index(text_col))))
            yield batch.filter(pa.array(p < threshold))

    return docs.mapInArrow(run, docs.schema)
