"""Exact deduplication by Grace hashing (operator 9)."""

from __future__ import annotations

import hashlib
import pickle
import struct
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm import shared

#: Bytes of distinct texts that a table holds before it is emptied (combiner) or its bucket is split (Grace).
BUDGET = 32 << 20
#: Spill files that one split makes.
FAN_OUT = 16
_TO_SPACE = bytes.maketrans(b"\t\n\v\f\r", b"     ")


def normalise(text: str | None) -> bytes:
    """UTF-8 of the text with each run of [\\x20\\x09-\\x0D] as one space; null is the empty text."""
    raw = (text or "").encode().translate(_TO_SPACE)
    while b"  " in raw:
        raw = raw.replace(b"  ", b" ")
    return raw


class Table:
    """Open addressing with linear probing. A hash finds the slot; complete contents decide."""

    def __init__(self) -> None:
        self.slots = [-1] * 1024
        self.hashes: list[int] = []
        self.texts: list[bytes] = []
        self.values: list[list] = []
        self.size = 0

    def add(self, h: int, text: bytes, payload: tuple) -> list:
        """Keep a payload with a text; its size counts, so a text that many rows have fills the table too."""
        values = self.values_of(h, text)
        values.append(payload)
        self.size += 48
        return values

    def values_of(self, h: int, text: bytes) -> list:
        """The list kept with a text; new and empty for a new text."""
        mask = len(self.slots) - 1
        i = (h ^ h >> 32) & mask
        while (k := self.slots[i]) >= 0:
            if self.hashes[k] == h and self.texts[k] == text:
                return self.values[k]
            i = (i + 1) & mask
        self.slots[i] = len(self.texts)
        self.hashes.append(h)
        self.texts.append(text)
        self.values.append(value := [])
        self.size += len(text) + 100
        if 2 * len(self.texts) > len(self.slots):
            self._grow()
        return value

    def _grow(self) -> None:
        self.slots = [-1] * (4 * len(self.slots))
        mask = len(self.slots) - 1
        for k, h in enumerate(self.hashes):
            i = (h ^ h >> 32) & mask
            while self.slots[i] >= 0:
                i = (i + 1) & mask
            self.slots[i] = k


Record = tuple[int, bytes, tuple]
_HEAD = struct.Struct("<QQI")
#: Levels of four hash bits each.
LEVELS = 16


def grace(records: Iterator[Record], budget: int, folder: str, level: int = 0, pick: Callable[[list[tuple]], tuple] | None = None) -> Iterator[tuple[int, bytes, list[tuple]]]:
    """(hash, text, payloads) of each distinct text among the records (hash, text, payload); pick keeps one payload.

    Records go to a table while its distinct texts fit the budget. Once they don't, table and rest are dealt by four
    more bits of the hash to spill files in the task's own folder, and each file is treated alike. Texts whose hashes
    agree in all bits share the last table, which splits no further.
    """
    table, files = Table(), None
    for h, text, payload in records:
        if files is not None:
            _spill(files, level, h, text, payload)
            continue
        values = table.add(h, text, payload)
        if pick and len(values) > 1:
            values[:] = [pick(values)]
            table.size -= 48
        if table.size > budget and level < LEVELS and len(table.texts) > 1:
            files = [tempfile.TemporaryFile(dir=folder) for _ in range(FAN_OUT)]
            for h, text, payloads in zip(table.hashes, table.texts, table.values):
                for payload in payloads:
                    _spill(files, level, h, text, payload)
            table = Table()
    yield from zip(table.hashes, table.texts, table.values)
    for f in files or ():
        f.seek(0)
        yield from grace(_unspill(f), budget, folder, level + 1, pick)
        f.close()


def _spill(files: list, level: int, h: int, text: bytes, payload: tuple) -> None:
    tail = pickle.dumps(payload, 5)
    files[h >> 4 * level & FAN_OUT - 1].write(_HEAD.pack(h, len(text), len(tail)) + text + tail)


def _unspill(f) -> Iterator[Record]:
    while head := f.read(_HEAD.size):
        h, n, k = _HEAD.unpack(head)
        yield h, f.read(n), pickle.loads(f.read(k))


def _order(key) -> tuple:
    """Sort key of an id: null comes last."""
    return (key is None, 0 if key is None else key)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET) -> DataFrame:
    """One row per document: (id, keep_id, group_size, kept, text_sha256) (operator 9).

    Texts are equal when identical after each run of [\\x20\\x09-\\x0D] has become one space; null counts as
    empty. The row with the smallest id stays, null ids last; of rows that share that id one stays. Repeated rows
    count as rows. Other columns, of any name, are not read; an empty table gives no rows.

    Each task first joins its own copies in a bounded table, so a text that a third of all rows hold is shuffled once a
    task. Only texts new to a task are shuffled, by hash, to tasks that hash and spill them (Grace) and compare whole
    contents. The verdicts go back to the rows over the task-local representatives, whose groups are small.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 40

        def flush(table: Table) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(table.texts), 4096):
                rows = []
                for h, text, members in zip(table.hashes[at : at + 4096], table.texts[at : at + 4096], table.values[at : at + 4096]):
                    first = min(members, key=lambda m: (_order(m[0]), m[1]))
                    rows.append((first[0], first[1], first[1], h - (1 << 64) if h >> 63 else h, len(members), text))
                    rows += [(m[0], m[1], first[1], None, None, None) for m in members if m[1] != first[1]]
                yield _batch(rows, batch_schema)

        table = Table()
        for batch in batches:
            batch_schema = pa.schema([("id", batch.schema.field(0).type), ("uid", pa.int64()), ("rep", pa.int64()), ("h", pa.int64()), ("n", pa.int64()), ("text", pa.binary())])
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = normalise(text.as_py())
                h = _hash(text)
                table.add(h, text, (key, uid))
                uid += 1
            if table.size > budget:
                yield from flush(table)
                table = Table()
        if table.texts:
            yield from flush(table)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list[pa.DataType] = []

        def records() -> Iterator[Record]:
            for batch in batches:
                kinds[:] = [batch.schema.field(0).type]
                for key, uid, h, n, text in zip(*(batch.column(i).to_pylist() for i in range(5))):
                    yield h & 0xFFFFFFFFFFFFFFFF, text, (key, uid, n)

        rows: list[tuple] = []
        schema = lambda: pa.schema([("rep", pa.int64()), ("keep_uid", pa.int64()), ("keep_id", kinds[0]), ("group_size", pa.int64()), ("text_sha256", pa.string())])
        for _, text, reps in grace(records(), budget, tempfile.gettempdir()):
            first = min(reps, key=lambda m: (_order(m[0]), m[1]))
            size, digest = sum(r[2] for r in reps), hashlib.sha256(text).hexdigest()
            rows += [(r[1], first[1], first[0], size, digest) for r in reps]
            if len(rows) >= 8192:
                yield _batch(rows, schema())
                rows = []
        if rows:
            yield _batch(rows, schema())

    rows = shared.table(docs.select(id_col, text_col).toDF("id", "text").mapInArrow(local, f"id {kind}, uid long, rep long, h long, n long, text binary"))
    reps = rows.where("text is not null").select("id", "uid", "h", "n", "text").repartition(shared.partitions(docs.sparkSession), "h")
    verdicts = reps.mapInArrow(merge, f"rep long, keep_uid long, keep_id {kind}, group_size long, text_sha256 string")
    out = rows.select("id", "uid", "rep").join(verdicts, "rep")
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"), "text_sha256")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _hash(text: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET) -> DataFrame:
    """The rows of docs that stay by the rules of exact_groups, with all their columns.

    Each task passes on one row of its own copies; rows are shuffled once, by hash, and the Grace tables keep the row
    that stays. Columns may have any names; their values are carried as they are. Of rows that share the smallest id
    the one that a task meets first stays. An empty table gives no rows.
    """
    own = shared.free_name(docs.columns, "h")
    at_id, at_text = docs.columns.index(id_col), docs.columns.index(text_col)
    first = lambda rows: min(rows, key=lambda m: _order(m[0]))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held, size = Table(), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            chosen: list[list[tuple[int, int]]] = [[] for _ in held]
            for h, ((_, k, i),) in zip(table.hashes, table.values):
                chosen[k].append((i, h - (1 << 64) if h >> 63 else h))
            for batch, rows in zip(held, chosen):
                rows.sort()
                kept = batch.take(pa.array([i for i, _ in rows], pa.int64()))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array([h for _, h in rows], pa.int64())], names=[*batch.schema.names, own])

        for batch in batches:
            for i, (key, text) in enumerate(zip(batch.column(at_id).to_pylist(), batch.column(at_text))):
                text = normalise(text.as_py())
                values = table.values_of(_hash(text), text)
                values.append((key, len(held), i))
                if len(values) > 1:
                    values[:] = [first(values)]
            held.append(batch)
            size += batch.nbytes
            if max(size // 4, table.size) > budget:
                yield from flush()
                table, held, size = Table(), [], 0
        yield from flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields: list[pa.Field] = []

        def records() -> Iterator[Record]:
            for batch in batches:
                fields[:] = list(batch.schema)[:-1]
                for row in zip(*(c.to_pylist() for c in batch.columns)):
                    yield row[-1] & 0xFFFFFFFFFFFFFFFF, normalise(row[at_text]), (row[at_id], row[:-1])

        rows: list[tuple] = []
        size = 0
        for _, text, ((_, row),) in grace(records(), budget // 2, tempfile.gettempdir(), pick=first):
            rows.append(row)
            size += len(text)
            if size > budget // 2:
                yield _batch(rows, pa.schema(fields))
                rows, size = [], 0
        if rows:
            yield _batch(rows, pa.schema(fields))

    hashed = T.StructType([*docs.schema.fields, T.StructField(own, T.LongType())])
    return docs.mapInArrow(local, hashed).repartition(shared.partitions(docs.sparkSession), F.col(f"`{own}`")).mapInArrow(merge, docs.schema)


ORACLE = """
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS norm, row_number() OVER () AS r FROM documents)
SELECT doc_id, first_value(doc_id) OVER g AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER g = 1 AS kept, sha256(norm) AS text_sha256
FROM t WINDOW g AS (PARTITION BY norm ORDER BY doc_id NULLS LAST, r)
"""
