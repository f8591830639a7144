"""Repeated passages by a sparse suffix array (operator 10).

Suffixes are kept only where a run of RUN words is the least of `spread` runs in a row (a minimiser), which depends on
the words alone: equal passages of RUN + spread - 1 words keep suffixes at the same places, so each passage belongs to
one suffix. A suffix travels with the words that its passages reach to the left and right of it. Suffixes of one run
meet in one task, are sorted by their words, and neighbours are compared for their longest common extension to the
right; the words before them are sorted backwards and compared likewise, for the extension to the left. A passage
stands elsewhere too if another suffix shares as many words on both sides as it has there.

Words are compared, never hashes of passages: a hash of the run only names the task. To travel short, words of a
vocabulary taken from a sample are sent as two bytes and the others in full. Runs that many sampled documents have are
chosen last, so a common line names no task unless the whole passage is as common, and then its suffixes have equal
words and one per task travels.
"""

from __future__ import annotations

import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import shared
from quillon.llm.wordhash import Words, chunks

#: Words of the run at which a suffix begins.
RUN = 10
#: Bytes of text whose suffixes a task compares before it sends them on.
LOCAL = 6 << 20
#: Suffixes that a task compares at once; a run with more of them, all different, is dealt to files by passage.
BLOCK, FILES = 1 << 16, 64
#: Documents (about) that vocabulary and common runs are taken from, most words and runs, documents that make a run common.
SAMPLE, VOCABULARY, COMMON_RUNS, COMMON = 20_000, 60_000, 1 << 16, 8
#: Stands for a word outside the vocabulary, which follows in full.
OTHER = 0xFFFF
#: kind of row: a document with its number of words, a span known to be repeated (n is its end), a suffix (n: 1 if repeated)
DOCUMENT, SPAN, SUFFIX = range(3)
NAMES = ["key", "uid", "rank", "at", "kind", "n", "left", "words", "rest"]
KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
ROWS = "key long, uid long, rank long, at int, kind int, n int, left int, words binary, rest binary"
_PASSAGES = pa.schema([("passage", pa.binary()), ("uid", pa.int64()), ("rank", pa.int64()), ("start", pa.int64()), ("many", pa.bool_())])


def minimisers(h: np.ndarray, width: int) -> np.ndarray:
    """For each place, where the least of the `width` values from it on stands, the leftmost of equals.

    The last width - 1 places, which have fewer values, are left out.
    """
    at = np.arange(len(h))
    have = 1
    while have < width:
        step = min(have, width - have)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(h[left] <= h[right], left, right)
        have += step
    return at


def _stretches(uid: np.ndarray, start: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where runs of consecutive passages of one text and one suffix begin."""
    new = np.ones(len(uid), bool)
    new[1:] = (uid[1:] != uid[:-1]) | (start[1:] != start[:-1] + 1) | (key[1:] != key[:-1])
    return np.flatnonzero(new)


def _from_sample(rows: DataFrame, run: int) -> tuple[list[bytes], np.ndarray]:
    """(vocabulary, hashes of common runs in order), both of bounded size; they change no result."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in chunks(batch.column(0)):
                w = Words(texts)
                if not len(w.starts):
                    continue
                seen = pc.value_counts(w.spelt())
                word, n = seen.field(0), seen.field(1)
                short = pc.less_equal(pc.binary_length(word), 40)
                word, n = word.filter(short), n.filter(short)
                yield pa.RecordBatch.from_arrays([word, pa.nulls(len(word), pa.int64()), n], names=["word", "run", "n"])
                h, inside = w.runs(run)
                text = np.repeat(np.arange(len(texts)), np.diff(w.first))
                pair = np.unique(np.stack([h[inside].view(np.int64), text[inside]]), axis=1)[0]  # once a text
                h, n = np.unique(pair, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(h), pa.binary()), pa.array(h), pa.array(n)], names=["word", "run", "n"])

    total = rows.count()
    step = max(1, total // SAMPLE)
    sample = rows.where(F.pmod(F.xxhash64("id", F.length("text")), F.lit(step)) == 0).select("text")
    sums = shared.table(sample.mapInArrow(count, "word binary, run long, n long").groupBy("word", "run").agg(F.sum("n").alias("n")).where("n > 1"))
    words = sums.where("word is not null").orderBy(F.desc("n"), "word").limit(VOCABULARY).select("word").toArrow()["word"].to_pylist()
    runs = sums.where(F.col("run").isNotNull() & (F.col("n") >= COMMON)).orderBy(F.desc("n"), "run").limit(COMMON_RUNS).select("run").toArrow()["run"].to_numpy()
    return words, np.sort(runs.view(np.uint64))


def _numbers(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers of the suffixes' words in a row, words of each, words to the left of each).

    Numbers are equal exactly for equal words: the code, or beyond the codes the place among the words in full.
    """
    words, rest = t["words"].combine_chunks(), t["rest"].combine_chunks()
    n = pc.binary_length(words).to_numpy().astype(np.int64) // 2
    ids = np.frombuffer(b"".join(words.to_pylist()), "<u2").astype(np.int64)
    full = np.frombuffer(b"".join(rest.to_pylist()), np.uint8)
    if len(full):
        ends = np.flatnonzero(full == 32) + 1
        spelt = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32).tobytes()), pa.py_buffer(full.tobytes())])
        ids[ids == OTHER] = OTHER + spelt.dictionary_encode().indices.to_numpy().astype(np.int64)
    return ids, n, t["left"].to_numpy().astype(np.int64)


def _sides(ids: np.ndarray, n: np.ndarray, n_left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers from each suffix on, and before it backwards, as rows; -1 fills up."""
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(ids)) - np.repeat(np.cumsum(n) - n + n_left, n)
    left, right = np.full((len(n), int(n_left.max(initial=0))), -1, np.int64), np.full((len(n), int((n - n_left).max(initial=0))), -1, np.int64)
    on = place >= 0
    right[row[on], place[on]] = ids[on]
    left[row[~on], -1 - place[~on]] = ids[~on]
    return left, right


def _sorted(run: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes sorted by run and words, how many words each has in common with the one before it); -1 where a run begins."""
    rows = np.concatenate([run[:, None], side + 1], 1).astype(">u4")
    order = np.argsort(np.ascontiguousarray(rows).view(f"S{4 * rows.shape[1]}").ravel(), kind="stable")
    common = np.full(len(run), -1)
    a, b = side[order[1:]], side[order[:-1]]
    same = np.logical_and.accumulate((a == b) & (a >= 0), 1).sum(1)
    common[1:] = np.where(run[order[1:]] == run[order[:-1]], same, -1)
    return order, common


def matches(run: np.ndarray, left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray, by_place: np.ndarray, min_words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(d, suffixes that have a passage with d words to the left of them, whether it stands twice, whether it stood before).

    Suffixes are sorted by the words from them on, and by those before them backwards; neighbours are compared. Two
    passages are equal exactly if their suffixes have d words in common to the left and the rest of min_words to the right.
    """
    order, common = _sorted(run, right)
    back, common_back = _sorted(run, left)
    a, b = np.empty(len(run), np.int64), np.empty(len(run), np.int64)
    for d in range(left.shape[1] + 1):
        mine = by_place[(n_left[by_place] >= d) & (n_right[by_place] >= min_words - d)]
        if not len(mine):
            continue
        a[order] = np.cumsum(common < min_words - d)
        b[back] = np.cumsum(common_back < d)
        both = a[mine] * (len(run) + 1) + b[mine]
        by = np.argsort(both, kind="stable")
        new = np.ones(len(by), bool)
        new[1:] = both[by[1:]] != both[by[:-1]]
        several = np.diff(np.append(np.flatnonzero(new), len(by))) > 1
        twice, before = np.zeros(len(by), bool), np.zeros(len(by), bool)
        twice[by] = several[np.cumsum(new) - 1]
        before[by] = ~new
        yield d, mine, twice, before


class _Dealt:
    """The passages of one run, dealt to files: the way for a run with more different suffixes than a task should hold."""

    def __init__(self, min_words: int):
        self.min_words = min_words
        self.files = [tempfile.TemporaryFile() for _ in range(FILES)]
        self.sinks = [pa.ipc.new_stream(f, _PASSAGES) for f in self.files]

    def add(self, t: pa.Table) -> None:
        out: list[list[tuple]] = [[] for _ in self.files]
        for u, r, at, many, n_left, words, rest in zip(*(t[c].to_pylist() for c in ("uid", "rank", "at", "n", "left", "words", "rest"))):
            full = iter(rest.split(b" "))
            spelt = [words[i : i + 2] if words[i : i + 2] != b"\xff\xff" else b"\xff\xff" + next(full) + b" " for i in range(0, len(words), 2)]
            for i in range(len(spelt) - self.min_words + 1):
                passage = b"".join(spelt[i : i + self.min_words])
                out[zlib.crc32(passage) % FILES].append((passage, u, r, at - n_left + i, many > 0))
        for sink, rows in zip(self.sinks, out):
            if rows:
                sink.write_batch(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PASSAGES)], schema=_PASSAGES))

    def found(self) -> Iterator[list[tuple[int, int, bool]]]:
        """(uid, start, extra) of passages that stand twice."""
        for f, sink in zip(self.files, self.sinks):
            sink.close()
            first: dict[bytes, tuple] = {}
            for again in (False, True):
                f.seek(0)
                for batch in pa.ipc.open_stream(f):
                    rows = []
                    for p, u, r, start, many in zip(*(c.to_pylist() for c in batch.columns)):
                        if not again:
                            known = first.get(p)
                            first[p] = (min((r, u, start), known[0]), True) if known else ((r, u, start), many)
                        elif first[p][1]:
                            rows += [(u, start, False)] if (r, u, start) == first[p][0] else [(u, start, False), (u, start, True)]
                    if rows:
                        yield rows
            f.close()


def repeated_spans(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (id, n_words, repeated_words, extra_words, spans, extra) (operator 10).

    spans are the word ranges [start, end) covered by passages of min_words words (A-Z lower-cased, words are
    [^\\x20\\x09-\\x0D]+) that stand at two places or more of the corpus, in other documents or the same; ranges that touch
    or overlap are one. extra are those left when each passage's first place, by smallest id and then position, is
    kept; for ids that aren't integers, or null, first means first read. The counts are the words covered. Null, empty
    and shorter texts have no spans; repeated rows are documents of their own and so repeat each other; other columns,
    of any name, are not read; an empty table gives no rows. A very long text is a block of its own.

    Suffixes with the same words around them travel once a block, and once a task if their run is a common one. A task
    holds the suffixes of whole runs, about BLOCK; a run with more different ones is dealt to files by its passages.
    """
    run = max(1, min(RUN, min_words))
    width = min_words - run + 1
    kind = docs.schema[id_col].dataType.simpleString()
    whole = kind in ("tinyint", "smallint", "int", "bigint")
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sent = spark.sparkContext.broadcast(_from_sample(source, run))  # at most VOCABULARY words and COMMON_RUNS hashes

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        vocabulary, common = pa.array(sent.value[0], pa.binary()), sent.value[1]
        waiting: dict[tuple, list] = {}  # suffixes of common runs, one for equal words, until the task ends
        id_kind = None

        def out(rows: list[tuple], ids: pa.Array | None = None) -> pa.RecordBatch:
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), KINDS)]
            return pa.RecordBatch.from_arrays([*columns, pa.nulls(len(rows), id_kind) if ids is None else ids], names=[*NAMES, "id"])

        def send(suffixes: dict[tuple, list]) -> Iterator[pa.RecordBatch]:
            rows = [(key, u, r, at, SUFFIX, many, left, *words) for (left, *words), (r, u, at, key, many, _) in suffixes.items()]
            for k in range(0, len(rows), 8192):
                yield out(rows[k : k + 8192])

        def block(held: list[tuple]) -> Iterator[pa.RecordBatch]:
            ids, texts, uids, ranks = zip(*held)
            w = Words(texts)
            yield out([(u, u, r, -1, DOCUMENT, k, None, None, None) for u, r, k in zip(uids, ranks, np.diff(w.first).tolist())], pa.array(ids, id_kind))
            h, _ = w.runs(run)
            at = np.flatnonzero(w.runs(min_words)[1])
            if not len(at):
                return
            usual = ~np.isin(h, common)
            suffix = minimisers(np.where(usual, h >> np.uint64(1), h | np.uint64(1 << 63)), width)[at]
            text = np.searchsorted(w.first, at, "right") - 1
            begin = _stretches(text, at, suffix)
            last = np.append(begin[1:], len(at)) - 1
            spelt = w.spelt()
            codes = pc.fill_null(pc.index_in(spelt, vocabulary), OTHER).to_numpy().astype("<u2")
            missing = codes == OTHER
            rest = spelt.filter(pa.array(missing)).to_pylist()
            before = np.concatenate([[0], np.cumsum(missing)]).tolist()
            raw, firsts, usual = codes.tobytes(), w.first.tolist(), usual[suffix[begin]].tolist()
            best: dict[tuple, list] = {}
            known: list[tuple] = []
            for low, high, s, key, t, often in zip(at[begin].tolist(), (at[last] + min_words).tolist(), suffix[begin].tolist(), h[suffix[begin]].view(np.int64).tolist(), text[begin].tolist(), usual):
                words = (s - low, raw[2 * low : 2 * high], b"".join(rest[before[low] : before[high]]))
                mine = [ranks[t], uids[t], s - firsts[t], key, 0, high - low]
                store = best if often else waiting
                other = store.get(words)
                if other is not None:  # the later one is repeated and extra, and needs no comparison
                    mine, late = (mine, other) if mine[:3] < other[:3] else (other, mine)
                    mine[4] = 1
                    known.append((late[1], late[1], late[0], late[2] - words[0], SPAN, late[2] - words[0] + late[5], None, None, None))
                store[words] = mine
            if known:
                yield out(known)
            yield from send(best)
            if len(waiting) > BLOCK:
                yield from send(waiting)
                waiting.clear()

        held, size, row = [], 0, 0
        for batch in batches:
            ids, id_kind = batch.column(0).to_pylist(), batch.schema.field(0).type
            for first, part in chunks(batch.column(1)):
                for i, t in enumerate(part, first):
                    uid = base + row
                    row += 1
                    held.append((ids[i], t, uid, ids[i] if whole and ids[i] is not None else (1 << 62) + uid))
                    size += len(t)
                    if size >= LOCAL:
                        yield from block(held)
                        held, size = [], 0
        if held:
            yield from block(held)
        yield from send(waiting)

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_kind = None

        def spans(uid: np.ndarray, start: np.ndarray, end: np.ndarray, extra: np.ndarray, ids: pa.Array | None = None) -> pa.RecordBatch:
            columns = [pa.array(uid, pa.int64()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(extra, pa.bool_()), pa.nulls(len(uid), id_kind) if ids is None else ids]
            return pa.RecordBatch.from_arrays(columns, names=["uid", "start", "end", "extra", "id"])

        def settle(t: pa.Table) -> Iterator[pa.RecordBatch]:
            key, many = t["key"].to_numpy(), t["n"].to_numpy() > 0
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            of = np.cumsum(new) - 1
            some = (np.bincount(of) > 1)[of] | many  # a run that stands once repeats nothing
            if not some.any():
                return
            t, of, many = t.filter(pa.array(some)), of[some], many[some]
            uid, rank, at = (t[c].to_numpy() for c in ("uid", "rank", "at"))
            ids, n, n_left = _numbers(t)
            left, right = _sides(ids, n, n_left)
            rows, starts, flags = [], [], []
            for d, mine, twice, before in matches(of, left, right, n_left, n - n_left, np.lexsort((at, uid, rank)), min_words):
                for pick, flag in ((twice | many[mine], False), (before, True)):
                    rows.append(mine[pick])
                    starts.append(at[mine[pick]] - d)
                    flags.append(np.full(len(rows[-1]), flag))
            row, start, extra = np.concatenate(rows), np.concatenate(starts), np.concatenate(flags)
            if len(row):
                order = np.lexsort((start, row, extra))
                row, start, extra = row[order], start[order], extra[order]
                begin = _stretches(row, start, extra)
                last = np.append(begin[1:], len(row)) - 1
                yield spans(uid[row[begin]], start[begin], start[last] + min_words, extra[begin])

        def united(t: pa.Table) -> tuple[pa.Table, list[tuple[int, int, int]]]:
            """A run's suffixes, one for equal words, and (uid, start, end) of those left out."""
            best: dict[tuple, tuple] = {}
            late: list[tuple] = []
            for i, (r, u, at, left, words, rest) in enumerate(zip(*(t[c].to_pylist() for c in ("rank", "uid", "at", "left", "words", "rest")))):
                mine, other = (r, u, at, i), best.get((left, words, rest))
                if other is not None:
                    mine, gone = (mine, other) if mine < other else (other, mine)
                    late.append((gone[1], gone[2] - left, gone[2] - left + len(words) // 2))
                    mine = (*mine[:4], True)
                best[left, words, rest] = mine
            rows = sorted(best.values(), key=lambda x: x[3])
            kept = t.take(pa.array([x[3] for x in rows], pa.int64()))
            many = pa.array([int(len(x) > 4 or n > 0) for x, n in zip(rows, kept["n"].to_pylist())], pa.int32())
            return kept.set_column(kept.schema.get_field_index("n"), "n", many), late

        def finish(dealt: _Dealt) -> Iterator[pa.RecordBatch]:
            for rows in dealt.found():
                u, start, extra = (np.array(c) for c in zip(*rows))
                yield spans(u, start, start + min_words, extra)

        held: list[pa.Table] = []
        count = 0
        dealt, dealt_key = None, None
        for batch in batches:
            id_kind = batch.schema.field("id").type
            t = pa.Table.from_batches([batch])
            what = batch.column("kind").to_numpy()
            for code in (DOCUMENT, SPAN):
                if (pick := what == code).any():
                    part = t.filter(pa.array(pick)).combine_chunks()
                    u, at, n = (part[c].to_numpy() for c in ("uid", "at", "n"))
                    for flag in (False, True)[: 1 + (code == SPAN)]:
                        yield spans(u, at, n, np.full(len(u), flag), part["id"].combine_chunks())
            t = t.filter(pa.array(what == SUFFIX)).drop_columns(["kind", "id"])
            while len(t):
                key = t["key"].to_numpy()
                if dealt is not None:
                    same = int((key == dealt_key).sum())  # keys come in order
                    dealt.add(t.slice(0, same))
                    t = t.slice(same)
                    if len(t):
                        yield from finish(dealt)
                        dealt = None
                    continue
                if count < BLOCK:
                    held.append(t)
                    count += len(t)
                    break
                now = held[-1]["key"][-1].as_py()
                same = int((key == now).sum())
                full = pa.concat_tables([*held, t.slice(0, same)])
                t = t.slice(same)
                if len(t):
                    yield from settle(full)
                    held, count = [], 0
                    continue
                open_run = full["key"].to_numpy() == now
                if not open_run.all():
                    yield from settle(full.filter(pa.array(~open_run)))
                    full = full.filter(pa.array(open_run))
                full, late = united(full)
                if late:
                    for flag in (False, True):
                        yield spans(*(np.array(c) for c in zip(*late)), np.full(len(late), flag))
                held, count = [full], len(full)
                if count >= BLOCK:
                    dealt, dealt_key = _Dealt(min_words), now
                    dealt.add(full)
                    held, count = [], 0
        if dealt is not None:
            yield from finish(dealt)
        if held:
            yield from settle(pa.concat_tables(held))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, covered, extra, lists, extras = [], [], [], [], []
            for found in batch.column(2).to_pylist():
                words.append(next(x["end"] for x in found if x["start"] < 0))
                for flag, total, out in ((False, covered, lists), (True, extra, extras)):
                    spans: list[list[int]] = []
                    for a, b in sorted((x["start"], x["end"]) for x in found if x["extra"] == flag and x["start"] >= 0):
                        if spans and a <= spans[-1][1]:
                            spans[-1][1] = max(b, spans[-1][1])
                        else:
                            spans.append([a, b])
                    total.append(sum(b - a for a, b in spans))
                    out.append([{"start": a, "end": b} for a, b in spans])
            ranges = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array(x, pa.int64()) for x in (words, covered, extra)), pa.array(lists, ranges), pa.array(extras, ranges)], names=["id", "n_words", "repeated_words", "extra_words", "spans", "extra"])

    suffixes = source.mapInArrow(local, f"{ROWS}, id {kind}")
    ordered = suffixes.repartition(shared.partitions(spark), "key").sortWithinPartitions("key")
    found = ordered.mapInArrow(neighbours, f"uid long, start int, end int, extra boolean, id {kind}")
    by_text = found.groupBy("uid").agg(F.max("id").alias("id"), F.collect_list(F.struct("start", "end", "extra")).alias("found"))  # bounded by the text's length
    out = by_text.mapInArrow(merged, f"id {kind}, n_words long, repeated_words long, extra_words long, spans array<struct<start:int,end:int>>, extra array<struct<start:int,end:int>>")
    return out.withColumnRenamed("id", id_col)


def without_repeats(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the extra copies of repeated passages cut out of the texts, whole words with the gap before each.

    Ids name documents: rows that share an id all lose the spans found in either. Rows without an id stay as they are.
    """
    spans = repeated_spans(docs, min_words, id_col, text_col).where("extra_words > 0").groupBy(id_col).agg(F.flatten(F.collect_list("extra")).alias("__extra")).withColumnRenamed(id_col, "__of")
    joined = docs.join(spans, docs[id_col] == spans["__of"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = batch.column(at).to_pylist()
            for i, found in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                if found and texts[i]:
                    raw = texts[i].encode()
                    w = Words([raw])
                    keep = np.ones(len(raw), bool)
                    for x in found:
                        a, b = x["start"], min(x["end"], len(w.starts))
                        keep[(w.ends[a - 1] if a else w.starts[0]) - 1 : w.ends[b - 1] - 1] = False  # Words puts a space first
                    texts[i] = np.frombuffer(raw, np.uint8)[keep].tobytes().decode()
            columns = [pa.array(texts, batch.schema.field(i).type) if i == at else batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    kept = joined.select(*(docs[c] for c in docs.columns), "__extra")
    return kept.mapInArrow(run, docs.schema)


ORACLE = """
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(ws) - 48)) AS a, ws FROM w WHERE len(ws) >= 50),
h AS (SELECT doc_id, a, md5(array_to_string(ws[a:a + 49], ' ')) AS g FROM p),
o AS (SELECT doc_id, a, count(*) OVER (PARTITION BY g) > 1 AS rep, row_number() OVER (PARTITION BY g ORDER BY doc_id, a) > 1 AS ext FROM h),
k AS (SELECT doc_id, a, 'rep' AS kind FROM o WHERE rep UNION ALL SELECT doc_id, a, 'ext' FROM o WHERE ext),
n AS (SELECT *, CASE WHEN a - lag(a) OVER (PARTITION BY doc_id, kind ORDER BY a) <= 50 THEN 0 ELSE 1 END AS new FROM k),
i AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, kind ORDER BY a) AS island FROM n),
s AS (SELECT doc_id, kind, min(a) - 1 AS b, max(a) + 49 AS e FROM i GROUP BY doc_id, kind, island),
t AS (SELECT doc_id, kind, sum(e - b)::BIGINT AS words, string_agg(b || '-' || e, ',' ORDER BY b) AS spans FROM s GROUP BY doc_id, kind)
SELECT w.doc_id, len(w.ws)::BIGINT AS n_words, coalesce(r.words, 0)::BIGINT AS repeated_words, coalesce(x.words, 0)::BIGINT AS extra_words,
       coalesce(r.spans, '') AS spans, coalesce(x.spans, '') AS extra_spans
FROM w LEFT JOIN t r ON r.doc_id = w.doc_id AND r.kind = 'rep' LEFT JOIN t x ON x.doc_id = w.doc_id AND x.kind = 'ext'
"""
