"""Mixing sources to target weights by capped water-filling (operator 6); DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm import shared

#: A table of sources of at most so many rows is broadcast; beyond it, it is joined by shuffle over salted sources.
BROADCAST_SOURCES = 10_000
SALTS = 64


def words(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def _by_source(left: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """left with the columns of its source's row. Sources come once each."""
    right = sources.withColumnRenamed("source", "__s")
    if sources.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        return left.join(F.broadcast(right), left[key].eqNullSafe(right["__s"])).drop("__s")
    right = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    left = left.withColumn("__left_salt", F.pmod(F.xxhash64("h"), F.lit(SALTS)).cast("int"))
    joined = left.join(right, left[key].eqNullSafe(right["__s"]) & (left["__left_salt"] == right["__salt"]))
    return joined.drop("__s", "__salt", "__left_salt")


def targets(sizes: DataFrame, share: float, cap: float, weights: tuple[int, ...]) -> DataFrame:
    """(source, source_size, target) from (source, source_size) by water-filling.

    Sources by code point, null last, take the weights in turn. `share` times all sizes is dealt by weight; a source
    above `cap` times its size is clamped there and the excess dealt again, until none is above. Clamped sources come
    first by cap over weight, so one pass over the sources in that order finds the level at which the rest stands.
    """
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    by_turn = F.array(*(F.lit(float(w)) for w in weights))
    s = sizes.withColumn("w", by_turn[turn]).withColumn("cap", F.col("source_size") * F.lit(float(cap)))
    whole = Window.partitionBy(F.lit(1))
    order = Window.partitionBy(F.lit(1)).orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    left = F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    s = s.withColumn("level", left / rest).withColumn("place", F.row_number().over(order))
    free = F.when(F.col("cap") >= F.col("level") * F.col("w"), F.struct("place", "level"))
    s = s.withColumn("level", F.min(free).over(whole)["level"])
    return s.select("source", "source_size", F.coalesce(F.least("cap", F.col("level") * F.col("w")), F.col("cap")).alias("target"))


def draw(seed: int, id_col: str, text_col: str) -> Column:
    """Seeded hash of a row: of its id, and of its text where the id is null, so that rows without an id draw apart."""
    own = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null|"), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    return F.md5(F.concat(F.lit(f"{seed}|"), own))


def repetitions(docs: DataFrame, seed: int, share: float, cap: float, weights: tuple[int, ...], id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, DataFrame]:
    """((id, source, size, h), (source, source_size, target, whole, cut)) of the mix.

    Each document comes `whole` times, and once more if its seeded hash h is at most its source's `cut`. The cut is
    exact: sums of sizes by the hash's first digits find the one bucket in which the fraction ends, and only that
    bucket is ordered.
    """
    h = draw(seed, id_col, text_col)
    base = shared.table(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"), h.alias("h")))
    bucket = F.substring("h", 1, 3).alias("bucket")
    sums = shared.table(base.groupBy("source", bucket).agg(F.sum("size").alias("s")))
    plan = targets(sums.groupBy("source").agg(F.sum("s").alias("source_size")), share, cap, weights)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = plan.withColumn("whole", F.least(F.floor(rate + 1e-12), F.floor(F.lit(float(cap)))).cast("long"))
    plan = shared.table(plan.withColumn("need", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size"))))
    by_bucket = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    edge = sums.withColumn("before", F.coalesce(F.sum("s").over(by_bucket), F.lit(0)))
    p = plan.select(F.col("source").alias("p"), "need")
    edge = edge.join(p, edge["source"].eqNullSafe(p["p"])).drop("p")
    # the bucket in which the running sum passes the need; nothing is needed at 0
    edge = edge.where((F.col("need") > 0) & (F.col("before") < F.col("need"))).groupBy("source").agg(F.max(F.struct("bucket", "before", "need")).alias("e"))
    edge = edge.select("source", "e.*").withColumnsRenamed({"bucket": "edge"})
    inner = _by_source(base.select("source", "size", "h"), edge, "source").where(F.substring("h", 1, 3) == F.col("edge"))
    inner = inner.groupBy("source", "h", "before", "need").agg(F.sum("size").alias("size"))
    by_hash = Window.partitionBy("source").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    inner = inner.withColumn("prior", F.col("before") + F.coalesce(F.sum("size").over(by_hash), F.lit(0)))
    cut = inner.where(F.col("prior") + F.col("size") / 2 <= F.col("need")).groupBy("source").agg(F.max("h").alias("cut"))
    e = edge.select(F.col("source").alias("e"), "edge")
    c = cut.select(F.col("source").alias("c"), "cut")
    full = plan.join(e, plan["source"].eqNullSafe(e["e"]), "left").join(c, plan["source"].eqNullSafe(c["c"]), "left")
    # no hash has a prefix that sorts below its bucket, so the bucket's name alone means: all buckets before it
    return base, shared.table(full.select("source", "source_size", "target", "whole", F.coalesce("cut", "edge", F.lit("")).alias("cut")))


def mix(docs: DataFrame, seed: int = 17, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = (5, 2, 1), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """What the mix takes of each document: (id, size, source_size, target, taken) (operator 6).

    Sizes are words; a null text has 0. A null source is a source, the last. Documents without words are taken as
    others are, with 0 words. Rows that share an id share their draw; rows without one draw by their texts, and share a draw
    only with equal texts. Repeated rows count each.
    No document is taken more than ceil(cap) times. Other columns are not read; an empty table gives no rows.
    """
    base, plan = repetitions(docs, seed, share, cap, weights, id_col, text_col, source_col)
    times = F.col("whole") + (F.col("h") <= F.col("cut")).cast("long")
    out = _by_source(base, plan, "source")
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * times).alias("taken"))


def mixed_documents(docs: DataFrame, seed: int = 17, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = (5, 2, 1), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: rows of docs with all their columns, of any names, each as often as the mix takes it; by the rules of
    mix() for nulls, empty and long texts, ties, repeated rows and an empty table."""
    _, plan = repetitions(docs, seed, share, cap, weights, id_col, text_col, source_col)
    h = draw(seed, id_col, text_col)
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(source_col).alias("source"), h.alias("h"))
    out = _by_source(packed, plan, "source")
    times = F.col("whole") + (F.col("h") <= F.col("cut")).cast("long")
    return out.withColumn("n", times.cast("int")).where("n > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("n")))).select("row.*")


ORACLE = """
WITH base AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5('17|' || coalesce(doc_id::VARCHAR, 'null|' || md5(coalesce(text, '')))) AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source),
w AS (SELECT *, (CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS w, source_size * 2.0::DOUBLE AS cap FROM s),
l AS (SELECT *, row_number() OVER b AS place, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
  FROM w WINDOW b AS (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, (SELECT arg_min(level, place) FROM l WHERE cap >= level * w) AS final FROM l),
t AS (SELECT source, source_size, coalesce(least(cap, final * w), cap) AS target FROM f),
p AS (SELECT *, least(floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END + 1e-12), 2)::BIGINT AS whole FROM t),
g AS (SELECT source, h, sum(size) AS hs FROM base GROUP BY source, h),
c AS (SELECT source, h, hs, coalesce(sum(hs) OVER (PARTITION BY source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM g),
x AS (SELECT c.source, max(c.h) AS cut FROM c JOIN p ON c.source IS NOT DISTINCT FROM p.source
  WHERE p.target - p.whole * p.source_size > 0 AND c.prior + c.hs / 2.0 <= p.target - p.whole * p.source_size GROUP BY c.source)
SELECT base.doc_id, base.size, p.source_size, p.target,
       (base.size * (p.whole + CASE WHEN base.h <= coalesce(x.cut, '') THEN 1 ELSE 0 END))::BIGINT AS taken
FROM base JOIN p ON base.source IS NOT DISTINCT FROM p.source LEFT JOIN x ON base.source IS NOT DISTINCT FROM x.source
"""
