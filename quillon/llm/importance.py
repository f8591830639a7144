"""Importance resampling towards a target distribution (operator 11).

1.  Tasks count hashed features of the corpus and of the target in arrays; their sums make one array of gains.
2.  A text's weight is the floored mean of its features' gains, and its score adds seeded Gumbel noise, so that the best
    scores are a draw without replacement by weight.
3.  Tasks sort their eligible rows into runs, cut at common bounds and packed in blocks that say where they belong. Rows
    of the parts are counted, which gives each part its first rank, and how many of its rows the draw takes.
4.  A part's blocks are spooled to a file of the task and merged by tournament trees of bounded fan-in. The merge stops
    after the exact count; blocks beyond the draw are passed on without a rank.
"""

from __future__ import annotations

import hashlib
import math
import tempfile
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain, islice, repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import shared

#: A-Z as a-z; other ASCII bytes than letters and digits as spaces; all bytes of other characters are word bytes.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: Bytes of a text that are split into words at a time.
PIECE = 1 << 20
#: Rows of a sorted run, of a block of it, and runs that one tournament takes.
RUN, BLOCK, FAN_IN = 1 << 18, 1 << 12, 64
#: Rows that are looked at for each bound between parts; parts for each shuffle partition.
PER_BOUND, PARTS = 100, 4


def features(text: bytes, n: int, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets of the runs of 1 to n words that end there) for a text's pieces, in order.

    A run's checksum goes on from that of the run without its last word.
    """
    text, at, held = text.translate(_WORDS), 0, []
    while at < len(text):
        end = text.find(b" ", at + PIECE) if len(text) - at > PIECE else -1
        end = len(text) if end < 0 else end
        new = text[at:end].split()
        at = end
        words = held + new
        runs: list[int] = []
        sums = list(map(crc32, words))
        for k in range(1, n + 1):  # sums are of the runs of k words from each word on
            runs += islice(sums, max(0, len(held) - k + 1), None)
            sums = list(map(crc32, words[k:], map(crc32, repeat(b" "), sums)))
        held = words[-(n - 1) :] if n > 1 else []
        yield len(new), np.array(runs, np.int64) % buckets


def feature_counts(texts: DataFrame, n: int, buckets: int) -> np.ndarray:
    """How often each bucket's features come in all texts (text); nulls have none. As many rows as buckets are collected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                for _, at in features((text.as_py() or "").encode(), n, buckets):
                    total += np.bincount(at, minlength=buckets)
        have = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(have), pa.array(total[have])], names=["b", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.mapInArrow(run, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).collect():
        out[r.b] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's smoothed shares in target and corpus, floored."""
    buckets, s_all, t_all = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + buckets) / ((s + 1.0) * (t_all + buckets)))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def noise(seed: int, key: int | None) -> int:
    """Seeded Gumbel noise of an id in thousandths, floored."""
    h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, seed: int, n: int, min_words: int) -> DataFrame:
    """(uid, id, n_features, weight, score, eligible) of documents (id, text)."""
    held = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain, uid = held.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = count = total = 0
                for more, at in features((text.as_py() or "").encode(), n, len(gain)):
                    words += more
                    count += len(at)
                    total += int(gain[at].sum())
                weight = total // count if count else 0
                rows.append((uid, key, count, weight, weight + noise(seed, key), words >= min_words))
                uid += 1
            columns = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(columns[5], pa.bool_())], names=["uid", "id", "n_features", "weight", "score", "eligible"])

    return shared.table(docs.mapInArrow(run, "uid long, id long, n_features long, weight long, score long, eligible boolean"))


# ---------------------------------------------------------------- runs

_FIELDS = ("id", "uid", "n_features", "weight", "score")
_RUNS = "part int, run long, seq int, n int, " + ", ".join(f"`{c}` array<long>" for c in _FIELDS)
#: Comes after all keys.
_END = (math.inf,)


def _key(score: int, key: int | None, uid: int) -> tuple:
    """Order of the draw: highest score, then smallest id, null last; uid tells rows of one id apart."""
    return (-score, key is None, key or 0, uid)


def bounds(rows: DataFrame, parts: int) -> list[tuple]:
    """At most parts - 1 keys that cut the rows into parts of about even size, from a bounded sample; any are right."""
    some = rows.sample(min(1.0, PER_BOUND * parts / max(1, rows.count())), seed=5).select("score", "id", "uid").limit(4 * PER_BOUND * parts)
    keys = sorted(_key(*r) for r in some.collect())
    return sorted({keys[i * len(keys) // parts] for i in range(1, parts)}) if keys else []


def sorted_runs(rows: DataFrame, cuts: list[tuple]) -> DataFrame:
    """Blocks (part, run, seq, n, fields) of the tasks' sorted runs; (run, seq) orders the blocks of a part's run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held, size = TaskContext.get().partitionId() << 32, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            key = table["id"].to_numpy(zero_copy_only=False) if not table["id"].null_count else table["id"].fill_null(0).to_numpy()
            null, uid, score = table["id"].is_null().to_numpy(), table["uid"].to_numpy(), table["score"].to_numpy()
            order = np.lexsort((uid, key, null, -score))
            table = table.take(pa.array(order))
            at = lambda i: (int(-score[order[i]]), bool(null[order[i]]), int(key[order[i]]) if not null[order[i]] else 0, int(uid[order[i]]))
            edges = [0, *(bisect_left(range(len(order)), cut, key=at) for cut in cuts), len(order)]
            for part, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
                for seq, first in enumerate(range(a, b, BLOCK)):
                    block = table.slice(first, min(BLOCK, b - first)).combine_chunks()
                    n = len(block)
                    lists = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), block[c].combine_chunks() if isinstance(block[c], pa.ChunkedArray) else block[c]) for c in _FIELDS]
                    head = [pa.array([part], pa.int32()), pa.array([name], pa.int64()), pa.array([seq], pa.int32()), pa.array([n], pa.int32())]
                    yield pa.RecordBatch.from_arrays([*head, *lists], names=["part", "run", "seq", "n", *_FIELDS])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= RUN:
                yield from flush()
                name, held, size = name + 1, [], 0
        if held:
            yield from flush()

    return shared.table(rows.select(*_FIELDS).mapInArrow(run, _RUNS))


class Tournament:
    """Loser tree over sorted cursors of (key, row): the winner's leaf is played again on its way up only."""

    def __init__(self, cursors: list[Iterator[tuple[tuple, tuple]]]):
        self.cursors = cursors
        self.leaves = 1 << max(0, len(cursors) - 1).bit_length()
        self.heads = [next(c, (_END, ())) for c in cursors] + [(_END, ())] * (self.leaves - len(cursors))
        self.losers = [0] * self.leaves
        winners = [0] * self.leaves + list(range(self.leaves))
        for i in range(self.leaves - 1, 0, -1):
            a, b = winners[2 * i], winners[2 * i + 1]
            winners[i], self.losers[i] = (a, b) if self.heads[a][0] <= self.heads[b][0] else (b, a)
        self.best = winners[1]

    def pop(self) -> tuple:
        """The least row left."""
        best = self.best
        _, row = self.heads[best]
        self.heads[best] = next(self.cursors[best], (_END, ()))
        i = (best + self.leaves) >> 1
        while i:
            if self.heads[self.losers[i]][0] < self.heads[best][0]:
                best, self.losers[i] = self.losers[i], best
            i >>= 1
        self.best = best
        return row

    def __iter__(self) -> Iterator[tuple]:
        while self.heads[self.best][0] is not _END:
            yield self.pop()

    def rest(self) -> Iterator[tuple]:
        """The rows left, in no order."""
        for head, cursor in zip(self.heads, self.cursors):
            yield from (row for key, row in chain([head], cursor) if key is not _END)


class Spool:
    """Blocks of runs in a file of the task, which goes when the task ends."""

    def __init__(self) -> None:
        self.file = tempfile.TemporaryFile()
        self.end = 0

    def put(self, block: np.ndarray) -> tuple[int, int]:
        """Where a block (rows x (null id, fields)) was put: (offset, rows)."""
        self.file.seek(self.end)
        self.file.write(block.tobytes())
        place = (self.end, len(block))
        self.end += block.nbytes
        return place

    def cursor(self, places: list[tuple[int, int]]) -> Iterator[tuple[tuple, tuple]]:
        """(key, row) of a run, a block at a time."""
        width = len(_FIELDS) + 1
        for offset, rows in places:
            self.file.seek(offset)
            block = np.frombuffer(self.file.read(8 * width * rows), np.int64).reshape(rows, width)
            for null, key, *rest in block.tolist():
                key = None if null else key
                yield _key(rest[3], key, rest[0]), (key, *rest)

    def rows(self, rows: Iterator[tuple]) -> list[tuple[int, int]]:
        """Where the blocks of a run of rows were put."""
        places = []
        while block := [(key is None, key or 0, *rest) for key, *rest in islice(rows, BLOCK)]:
            places.append(self.put(np.array(block, np.int64)))
        return places


def merged(spool: Spool, runs: list[list[tuple[int, int]]]) -> Tournament:
    """The last tournament of sorted runs; where there are more than FAN_IN, groups of them are first merged to longer runs."""
    while len(runs) > FAN_IN:
        runs = [spool.rows(iter(Tournament([spool.cursor(r) for r in runs[i : i + FAN_IN]]))) for i in range(0, len(runs), FAN_IN)]
    return Tournament([spool.cursor(r) for r in runs])


def ranked(runs: DataFrame, first: dict[int, int], draw: int) -> DataFrame:
    """(id, n_features, weight, score, rank) of the runs' rows; the first `draw` ranks are given, then nulls.

    first is the number of rows before each part that the draw reaches.
    """
    flat = ", ".join(f"r.{c} AS {c}" for c in ("id", "n_features", "weight", "score"))
    beyond = runs.where(~F.col("part").isin(list(first)) if first else F.lit(True))
    rest = beyond.select(F.explode(F.arrays_zip(*_FIELDS)).alias("r")).selectExpr(*flat.split(", "), "CAST(NULL AS long) AS rank")
    if not first:
        return rest

    def out(rows: list[tuple], ranks: Iterable[int | None]) -> pa.RecordBatch:
        key, _, count, weight, score = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (key, count, weight, score, list(ranks))], names=["id", "n_features", "weight", "score", "rank"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spool, parts = Spool(), defaultdict(lambda: defaultdict(list))
        for batch in batches:
            for i in range(batch.num_rows):
                part, name, seq = (batch.column(c)[i].as_py() for c in range(3))
                values = [batch.column(c)[i].values for c in range(4, 4 + len(_FIELDS))]
                block = np.stack([values[0].is_null().to_numpy(zero_copy_only=False).astype(np.int64), values[0].fill_null(0).to_numpy(), *(v.to_numpy() for v in values[1:])], 1)
                parts[part][name].append((seq, *spool.put(block)))
        for part in sorted(parts):
            order = merged(spool, [[place[1:] for place in sorted(p)] for p in parts[part].values()])
            at = first[part]
            while rows := list(islice(order, min(BLOCK, draw - at))):
                yield out(rows, range(at + 1, at + 1 + len(rows)))
                at += len(rows)
            left = order.rest()  # beyond the exact count no order is needed
            while rows := list(islice(left, BLOCK)):
                yield out(rows, repeat(None, len(rows)))

    drawn = runs.where(F.col("part").isin(list(first))).repartitionById(shared.partitions(runs.sparkSession), F.col("part"))
    return drawn.mapInArrow(run, "id long, n_features long, weight long, score long, rank long").unionByName(rest)


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, n: int = 2, buckets: int = 10_000, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (id, n_features, weight, score, rank); rank is null where it wasn't drawn (operator 11).

    Words are runs of ASCII letters and digits and of all other characters, A-Z lower-cased. Features are the runs of 1
    to n words; a feature's gain is the log ratio of its bucket's smoothed shares in target and docs, a weight the floored mean
    of gains (0 without features). Of the documents with at least min_words words the highest floor(percent / 100 of
    them) scores are drawn, ties by smaller id. Ids are integers; a null id has noise of its own, that of no text, and comes
    after the others in ties; rows that share an id and a score get ranks of their own, in no fixed order. Null and empty
    texts have no features. Long texts are read in pieces, whole. Other columns, of any name, are not read. An empty
    table gives no rows, an empty target gains that favour rare buckets.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    gain = gains(feature_counts(rows.select("text"), n, buckets), feature_counts(target.select(text_col), n, buckets))
    all_rows = scored(rows, gain, seed, n, min_words)
    able = all_rows.where("eligible")
    runs = sorted_runs(able, bounds(able, PARTS * shared.partitions(docs.sparkSession)))
    sizes = sorted(tuple(r) for r in runs.groupBy("part").agg(F.sum("n")).collect())  # a row for each part
    draw, first, before = percent * sum(s for _, s in sizes) // 100, {}, 0
    for part, size in sizes:
        if before < draw:
            first[part] = before
        before += size
    out = ranked(runs, first, draw).unionByName(all_rows.where("NOT eligible").selectExpr("id", "n_features", "weight", "score", "CAST(NULL AS long) AS rank"))
    return out.withColumnRenamed("id", id_col)


ORACLE = """
WITH tab AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM range(256) x(i))),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
f AS MATERIALIZED (SELECT r, g, count(*) AS n FROM (SELECT r, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS g FROM d) GROUP BY r, g),
q AS MATERIALIZED (SELECT g, count(*) AS n FROM (SELECT unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS g FROM b) GROUP BY g),
v AS (SELECT g, hex(encode(g)) AS x FROM (SELECT g FROM f UNION SELECT g FROM q)),
h AS MATERIALIZED (SELECT g, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(len(x) // 2), lambda i: ('0x' || x[2 * i + 1:2 * i + 2])::BIGINT)),
  lambda c, y: xor(t[(xor(c, y) & 255) + 1], c >> 8))) % 10000 AS k FROM v, tab),
s AS (SELECT k, sum(n)::DOUBLE AS s FROM f JOIN h USING (g) GROUP BY k),
t AS (SELECT k, sum(n)::DOUBLE AS t FROM q JOIN h USING (g) GROUP BY k),
w AS (SELECT k, floor(1000 * ln((coalesce(t, 0) + 1) * ((SELECT coalesce(sum(s), 0) FROM s) + 10000) / ((coalesce(s, 0) + 1) * ((SELECT coalesce(sum(t), 0) FROM t) + 10000))))::BIGINT AS gain FROM s FULL JOIN t USING (k)),
m AS (SELECT r, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS total FROM f JOIN h USING (g) JOIN w USING (k) GROUP BY r),
z AS (SELECT doc_id, len(ws) AS words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0)::BIGINT AS weight,
  ('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN m USING (r)),
y AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM z),
o AS (SELECT *, CASE WHEN words >= 20 THEN row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id ASC NULLS LAST) END AS place FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT 25 * count(*) // 100 FROM z WHERE words >= 20) THEN place END AS rank FROM o
"""
