"""Tables and files in the shared folder of the cluster, which every executor and the driver reach."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a table may have to be broadcast; rows of one key that make it a hot one.
BROADCAST_ROWS, HOT = 50_000, 500

_own: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """A new folder name below spark.checkpoint.dir, which executors and driver share.

    Where that is unset a local session gets a temporary folder of its own; a cluster raises an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _own.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="quillon-"))
    return f"{base.rstrip('/')}/quillon-{uuid.uuid4().hex}"


def table(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage, survives lost executors, is computed once."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(columns: list[str], name: str) -> str:
    """A column name that isn't taken yet."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def partitions(spark: SparkSession, least: int = 1) -> int:
    """Number of shuffle partitions of the session."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def joined(left: DataFrame, right: DataFrame, keys: list[str], weight: str, how: str = "left") -> DataFrame:
    """left with the columns of right, which has each key once and, as `weight`, about how many rows of left have it.

    A short right side is broadcast, after it was counted. Else the keys with most rows, at most BROADCAST_ROWS, are
    broadcast to their rows, and only the other rows are shuffled; so no task gets more than one key's rows beyond them.
    Keys aren't null.
    """
    if right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(right.drop(weight)), keys, how)
    hot = table(right.where(F.col(weight) > HOT).orderBy(F.desc(weight)).limit(BROADCAST_ROWS))
    if hot.isEmpty():
        return left.join(right.drop(weight), keys, how)
    few = F.broadcast(hot.drop(weight))
    return left.join(few, keys).unionByName(left.join(F.broadcast(hot.select(keys)), keys, "left_anti").join(right.drop(weight), keys, how))


def range_parts(df: DataFrame, column: str, tie: Column, n: int, nulls_last: bool = True) -> tuple[Column, int]:
    """(number of the part of a row, how many parts): about n parts of even size in the order of (column, tie).

    tie is a number from 0 to 1. Values of which one fills several parts are dealt to these by the tie, nulls likewise.
    Bounds come from approximate percentiles for integers, else from a sample of about 100 values a part.
    """
    rows, nulls = df.agg(F.count("*"), F.count_if(F.col(column).isNull())).first()
    most = max(1, round(n * (rows - nulls) / max(rows, 1)))
    bounds: list = []
    if most > 1:
        if df.schema[column].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint"):
            bounds = df.select(F.percentile_approx(column, F.array(*(F.lit(i / most) for i in range(1, most))), 10_000).alias("c")).first()["c"] or []
        else:
            seen = sorted(r[0] for r in df.select(column).where(F.col(column).isNotNull()).sample(min(1.0, 100 * most / max(rows - nulls, 1)), seed=7).limit(400 * most).collect())
            bounds = [seen[i * len(seen) // most] for i in range(1, most)] if seen else []
    times = {b: bounds.count(b) for b in sorted(set(bounds))}
    for_nulls = max(1, round(n * nulls / max(rows, 1)))
    at = 0 if nulls_last else for_nulls
    steps = []  # a bound, the part below it, and how many parts are its own
    for b, k in times.items():
        steps.append((b, at, k if k > 1 else 0))
        at += k if k == 1 else k + 1
    own = lambda k: F.least(F.floor(tie * k), F.lit(k - 1)).cast("int")

    def place(few: list, rest: int) -> Column:
        if not few:
            return F.lit(rest)
        m = len(few) // 2
        b, part, k = few[m]
        here = F.when(F.col(column) < F.lit(b), place(few[:m], part)) if m else F.when(F.col(column) < F.lit(b), F.lit(part))
        return here.when(F.col(column) == F.lit(b), F.lit(part + 1) + own(k) if k else F.lit(part)).otherwise(place(few[m + 1 :], rest))

    null_part = (F.lit(at + 1) if nulls_last else F.lit(0)) + own(for_nulls)
    return F.when(F.col(column).isNull(), null_part).otherwise(place(steps, at)).cast("int"), at + 1 + (for_nulls if nulls_last else 0)


def tie(text: Column) -> Column:
    """A number from 0 to 1 by a hash of the text, to order rows that share an id."""
    return F.xxhash64(text) / F.lit(float(1 << 64)) + F.lit(0.5)
