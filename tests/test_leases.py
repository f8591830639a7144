"""Leases on a stream: expiry by timer, claimable again in a later micro-batch, and the batch operator's answer."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillon.operators import queue as Q
from quillon.streaming import leases as L

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "queue string, at timestamp, kind string, task_id string, worker_id string, priority int"


def minute(m):
    return T0 + dt.timedelta(minutes=m)


def run(spark, tmp_path, name, batches):
    """All answers to events that come in these micro-batches."""
    L.use_timers(spark)
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{i}"))
        folder = tmp_path / "in"
        folder.mkdir(exist_ok=True)
        for f in (tmp_path / f"in{i}").glob("*.parquet"):
            f.rename(folder / f"{i}-{f.name}")
        stream = spark.readStream.schema(SCHEMA).parquet(str(folder))
        out = L.leases(stream, 600)
        out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("at", "outcome", "task_id").collect()]


def test_an_expired_lease_is_claimable_again(spark, tmp_path):
    add = [("q", minute(0), "add", t, None, p) for t, p in (("a", 2), ("b", 1), ("c", 1))]
    got = run(
        spark, tmp_path, "leases",
        [
            [*add, ("q", minute(1), "claim", None, "w1", None), ("q", minute(2), "claim", None, "w2", None), ("q", minute(0), "add", "b", None, 9)],
            [("q", minute(8), "beat", "c", "w2", None), ("q", minute(9), "beat", "b", "w2", None), ("q", minute(9), "beat", "z", "w2", None)],
            [("q", minute(13), "add", "d", None, 3)],  # the watermark passes w1's lease
            [("q", minute(14), "claim", None, "w3", None), ("q", minute(14), "beat", "b", "w1", None), ("q", minute(15), "done", "c", "w2", None), ("q", minute(15), "claim", None, "w4", None)],
            [("q", minute(16), "release", "a", "w4", None), ("q", minute(17), "claim", None, "w5", None)],
        ],
    )
    short = [(r[1], r[2], r[3], (r[4] - T0).total_seconds() / 60, r[6]) for r in got]
    assert short == [
        ("b", "w1", "claimed", 1.0, 1), ("c", "w2", "claimed", 2.0, 1), ("c", "w2", "kept", 8.0, 1), ("b", "w2", "lease_lost", 9.0, None), ("z", "w2", "no_such_task", 9.0, None), ("b", "w1", "expired", 11.0, 1),
        ("b", "w3", "claimed", 14.0, 2), ("b", "w1", "lease_lost", 14.0, None), ("a", "w4", "claimed", 15.0, 1), ("c", "w2", "done", 15.0, 1), ("a", "w4", "released", 16.0, 1), ("a", "w5", "claimed", 17.0, 2),
    ]


def test_claims_are_those_of_the_batch(spark, tmp_path):
    tasks = [(f"t{i:02d}", (i * 7) % 4, minute(i % 3)) for i in range(12)]
    workers = [f"w{i}" for i in range(5)]
    got = run(spark, tmp_path, "same", [[("q", at, "add", t, None, p) for t, p, at in tasks], [("q", minute(5), "claim", None, w, None) for w in workers]])
    table = spark.createDataFrame([(t, "pending", p, at, None, None, 0) for t, p, at in tasks], "task_id string, status string, priority int, created_at timestamp, claimed_by string, lease_expires_at timestamp, attempts int")
    _, claims = Q.claim(table, spark.createDataFrame([(w,) for w in workers], "worker_id string"), F.lit(minute(5)), 600, 5)
    assert {(r[1], r[2], r[5]) for r in got} == {(r.task_id, r.worker_id, r.expires) for r in claims.collect()}


def test_a_lease_takes_time(spark):
    with pytest.raises(ValueError):
        L.leases(spark.createDataFrame([], SCHEMA), 0)
