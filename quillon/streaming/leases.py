"""A lease queue on a stream: claims, heartbeats, releases and expiry by timers."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Timers need a state store that keeps them.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "queue string, task_id string, worker_id string, outcome string, at timestamp, expires timestamp, attempts int"
#: Within one time, what is given to the queue comes before what is asked of it.
ORDER = {"add": 0, "done": 1, "release": 2, "beat": 3, "claim": 4}


def _time(x) -> pd.Timestamp | None:
    """A time without zone, as events have it; None for none."""
    if x is None or pd.isna(x):
        return None
    x = pd.Timestamp(x)
    return x.tz_convert("UTC").tz_localize(None) if x.tzinfo else x


class Leases(StatefulProcessor):
    """State of one queue: its open tasks, and for each held one a timer at the end of its lease."""

    def __init__(self, lease_seconds: int):
        self.lease = pd.Timedelta(seconds=lease_seconds)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tasks = handle.getMapState("tasks", "task_id string", "priority int, created_at timestamp, worker_id string, expires timestamp, attempts int")

    def _open(self) -> dict[str, list]:
        return {k[0]: [v[0], _time(v[1]), v[2], _time(v[3]), v[4]] for k, v in self.tasks.iterator()}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows))
        events = events.assign(turn=events["kind"].map(ORDER)).sort_values(["at", "turn", "worker_id", "task_id"], kind="stable")
        open_, changed, out = self._open(), set(), []
        # claimable tasks by priority, age and id; a task may stand in it more than once, and is looked at again when taken
        heap = [(v[0], v[1], k) for k, v in open_.items()]
        heapq.heapify(heap)
        for at, kind, task, worker, priority in zip(*(events[c].tolist() for c in ("at", "kind", "task_id", "worker_id", "priority"))):
            at, task, worker = _time(at), None if pd.isna(task) else task, None if pd.isna(worker) else worker
            v = open_.get(task)
            if kind == "add":
                if v is None:
                    open_[task] = [int(priority), at, None, None, 0]
                    heapq.heappush(heap, (int(priority), at, task))
                    changed.add(task)
                continue
            if kind == "claim":
                busy = []
                while heap:
                    item = heapq.heappop(heap)
                    v = open_.get(item[2])
                    if v is None or v[2] is not None and v[3] > at:
                        busy += [item] if v is not None else []
                        continue
                    v[2:] = [worker, at + self.lease, v[4] + 1]
                    busy.append(item)
                    changed.add(item[2])
                    self.handle.registerTimer(int(v[3].value // 1_000_000))
                    out.append((key[0], item[2], worker, "claimed", at, v[3], v[4]))
                    break
                else:
                    out.append((key[0], None, worker, "nothing", at, None, None))
                for item in busy:
                    heapq.heappush(heap, item)
                continue
            held = v is not None and v[2] == worker and worker is not None
            if not held:
                out.append((key[0], task, worker, "no_such_task" if v is None else "lease_lost", at, None, None))
                continue
            changed.add(task)
            if kind == "done":
                del open_[task]
                out.append((key[0], task, worker, "done", at, None, v[4]))
            elif kind == "release":
                v[2:4] = [None, None]
                out.append((key[0], task, worker, "released", at, None, v[4]))
            else:
                v[3] = at + self.lease
                self.handle.registerTimer(int(v[3].value // 1_000_000))
                out.append((key[0], task, worker, "kept", at, v[3], v[4]))
        for task in changed:
            if task in open_:
                self.tasks.updateValue((task,), tuple(open_[task]))
            elif self.tasks.containsKey((task,)):
                self.tasks.removeKey((task,))
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")
        out = []
        for task, v in sorted(self._open().items()):
            if v[2] is not None and v[3] <= now:
                out.append((key[0], task, v[2], "expired", v[3], None, v[4]))
                self.tasks.updateValue((task,), (v[0], v[1], None, None, v[4]))
        yield _frame(out)

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    df = pd.DataFrame(rows, columns=["queue", "task_id", "worker_id", "outcome", "at", "expires", "attempts"])
    return df.astype({"at": "datetime64[us]", "expires": "datetime64[us]", "attempts": "Int32"})


def use_timers(spark: SparkSession) -> None:
    """Let the session's streams keep timers; for new streams only."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def leases(events: DataFrame, lease_seconds: int, delay: str = "0 seconds") -> DataFrame:
    """(queue, task_id, worker_id, outcome, at, expires, attempts) of a stream of events (queue, at, kind, task_id,
    worker_id, priority).

    Kinds are add, claim, beat, release and done, in the order of their times, at one time in this order: add, done,
    release, beat, claim. A claim takes the next task by priority, age and id that nobody holds, or whose lease is over, and
    counts as an attempt; a beat lengthens the lease of who holds it; whoever doesn't is told that it is lost. A timer
    ends each lease as soon as the watermark, `delay` behind the events, has passed it, and says so. Adding a task again
    changes nothing. A queue is one key: split one that is too large for a task by its name.
    """
    if lease_seconds <= 0:
        raise ValueError("a lease takes time")
    return events.withWatermark("at", delay).groupBy("queue").transformWithStateInPandas(Leases(lease_seconds), OUT, "Append", "EventTime")
