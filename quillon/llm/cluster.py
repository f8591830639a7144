"""Centroid clustering (operator 12): exact integer k-means, screened by float32 matrix products.

Components are integers, so that sums, floors and distances have one right answer on any cluster. A round looks at each
vector once: a float32 matrix product gives all its distances to the centroids, each with an interval that is sure to hold
the true one. Where only one interval reaches below the least upper end, its centroid is the nearest; the others are
computed again with exact integers, and equal distances go to the smaller number. What travels is a sum for each centroid
and component, by task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import shared

#: Integers saturate here, so that a squared distance over up to 128 components fits a long.
BOUND = 1 << 27
#: Pairs of vectors and centroids that are computed exactly at a time; vectors that are screened at a time.
PAIRS, ROWS = 1 << 14, 1 << 12
#: Unit roundoffs of float32 and, generously, of float64.
U32, U64 = 2.0**-24, 2.0**-50


def whole_vectors(vectors: DataFrame, dim: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(id, x) of the vectors with exactly dim components, none null or non-finite; x as integers floor(scale * component)."""
    v = F.col(vector_col)
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    x = F.transform(v, lambda c: F.greatest(F.lit(-BOUND), F.least(F.lit(BOUND), F.floor(c.cast("double") * F.lit(float(scale))))).cast("int"))
    return vectors.where((F.size(v) == dim) & ~F.exists(v, bad)).select(F.col(id_col).alias("id"), x.alias("x"))


def screen(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """(vectors x centroids) whether a centroid may be a vector's nearest, by float32 products and their error bounds.

    |x - c|**2 less |x|**2 is c.c - 2 x.c. A float32 product of n components, whatever the order of its sum, is off by at
    most g(n + 2) * sum |x_i c_i|, with g(n) = n u / (1 - n u); two more roundings stand for integers above 2**24. The sum
    is at most |x| |c|.
    """
    n = (x.shape[1] + 4) * U32
    dot = (x.astype(np.float32) @ c.astype(np.float32).T).astype(np.float64)
    wide_x, wide_c = x.astype(np.float64), c.astype(np.float64)
    norm_x = np.sqrt((wide_x * wide_x).sum(1)) * (1 + x.shape[1] * U64)
    square_c = (wide_c * wide_c).sum(1)
    norm_c = np.sqrt(square_c) * (1 + x.shape[1] * U64)
    off = 2 * n / (1 - n) * np.outer(norm_x, norm_c) + (x.shape[1] + 4) * U64 * (square_c + 2 * np.abs(dot))
    score = square_c - 2 * dot
    return score - off <= (score + off).min(1)[:, None]


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows of x and rows of c, in exact integers."""
    apart = x.astype(np.int64) - c.astype(np.int64)
    return (apart * apart).sum(1)


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, int]:
    """(number of the nearest centroid of each vector, pairs that were computed exactly)."""
    label, settled = np.zeros(len(x), np.int64), 0
    for a in range(0, len(x), ROWS):
        block = x[a : a + ROWS]
        maybe = screen(block, c)
        label[a : a + ROWS] = maybe.argmax(1)
        again = np.flatnonzero(maybe.sum(1) > 1)
        step = max(1, PAIRS // max(1, len(c)))
        for b in range(0, len(again), step):
            i, j = np.nonzero(maybe[again[b : b + step]])
            i = again[b : b + step][i]
            d = squares(block[i], c[j])
            order = np.lexsort((j, d, i))
            first = order[np.flatnonzero(np.diff(i[order], prepend=-1))]
            label[a + i[first]] = j[first]
            settled += len(i)
    return label, settled


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _moved(kept: DataFrame, c: np.ndarray) -> np.ndarray:
    """The centroids after one round: floors of the means of the vectors nearest to each; empty ones stay."""
    k, dim = c.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), dim)
            label, _ = nearest(x, c)
            order = np.argsort(label, kind="stable")
            have, first = np.unique(label[order], return_index=True)
            if len(have):
                total[have] += np.add.reduceat(x[order].astype(np.int64), first, axis=0)
                count += np.bincount(label, minlength=k)
        have = np.flatnonzero(count)
        columns = [np.repeat(have, dim), np.tile(np.arange(dim), len(have)), total[have].reshape(-1), np.repeat(count[have], dim)]
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in columns], names=["c", "j", "s", "n"])

    sums = kept.select("x").mapInArrow(run, "c long, j long, s long, n long")
    sums = sums.groupBy("c", "j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n"))
    out = c.copy()
    for r in sums.collect():  # as many rows as centroids have components
        out[r.c, r.j] = int(r.s) // r.n
    return out


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, dim: int = 64, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per kept vector: (id, cluster, distance, cluster_inertia, inertia, centroid_sha256) (operator 12).

    Vectors are kept that have exactly dim components, none null or non-finite; null vectors are left out. Components
    become integers floor(scale * x), which saturate at 2**27. Centroids start as the k vectors with smallest sha256 of
    `seed:id`, then smallest components; vectors without an id hash `seed:`. Fewer than k kept vectors are as many
    centroids. Each round moves the centroids to the floors of their vectors' means; once nothing moves, later rounds
    would not either. Ties go to the smaller number, so copies of a vector share a cluster. Repeated rows and ids count
    each; other columns, of any name, are not read; an empty table gives no rows. An inertia that no long can hold is
    the largest long.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    kept = shared.table(whole_vectors(vectors, dim, scale, id_col, vector_col))
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    starts = kept.select(h.alias("h"), "x").orderBy("h", "x").limit(k).collect()
    c = np.array([r.x for r in starts], np.int64).reshape(len(starts), dim)
    for _ in range(rounds if len(c) else 0):
        before, c = c, _moved(kept, c)
        if (before == c).all():
            break

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), dim)
            label, _ = nearest(x, c) if len(x) else (np.zeros(0, np.int64), 0)
            far = squares(x, c[label]) if len(x) else label
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(label, pa.int32()), pa.array(far, pa.int64())], names=["id", "cluster", "distance"])

    found = shared.table(kept.mapInArrow(run, f"id {kind}, cluster int, distance long"))
    most = Decimal((1 << 63) - 1)
    sums = [(r.cluster, r.s) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()]  # k rows at most
    total = int(min(most, sum((s for _, s in sums), Decimal(0))))
    digest = lambda j: hashlib.sha256(",".join(map(str, c[j].tolist())).encode()).hexdigest()
    rows = [(j, int(min(most, s)), total, digest(j)) for j, s in sums]
    own = vectors.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = found.join(F.broadcast(own), "cluster")
    return out.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(k: int, rounds: int, seed: int, dim: int, scale: int) -> str:
    """The same in DuckDB SQL: one pair of tables a round."""
    near = """SELECT r, arg_min(c, d * {k} + c) AS c, min(d) AS d FROM (SELECT e.r, o.c, sum((e.v - o.v) * (e.v - o.v))::BIGINT AS d
      FROM e JOIN c{at} o ON e.j = o.j GROUP BY e.r, o.c) GROUP BY r"""
    parts = [
        f"""WITH t AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda y: floor({scale} * y::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0)""",
        f"e AS MATERIALIZED (SELECT r, unnest(x) AS v, unnest(range({dim})) AS j FROM t)",
        f"f AS (SELECT r, row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(vec_id::VARCHAR, '')), x) - 1 AS c FROM t)",
        f"c0 AS MATERIALIZED (SELECT f.c, e.j, e.v FROM f JOIN e USING (r) WHERE f.c < {k})",
    ]
    for at in range(rounds):
        parts.append(f"n{at} AS MATERIALIZED ({near.format(k=k, at=at)})")
        parts.append(f"""m{at} AS (SELECT n.c, e.j, sum(e.v)::BIGINT AS s, count(*) AS n FROM n{at} n JOIN e USING (r) GROUP BY n.c, e.j)""")
        # floor division of integers: SQL's own rounds towards zero
        parts.append(f"""c{at + 1} AS MATERIALIZED (SELECT o.c, o.j, CASE WHEN m.n IS NULL THEN o.v ELSE (m.s - ((m.s % m.n) + m.n) % m.n) // m.n END AS v
  FROM c{at} o LEFT JOIN m{at} m ON o.c = m.c AND o.j = m.j)""")
    parts.append(f"z AS MATERIALIZED ({near.format(k=k, at=rounds)})")
    parts.append(f"g AS (SELECT c, sha256(string_agg(v::VARCHAR, ',' ORDER BY j)) AS h FROM c{rounds} GROUP BY c)")
    return ",\n".join(parts) + """
SELECT t.vec_id, z.c::INTEGER AS cluster, z.d AS distance, (sum(z.d) OVER (PARTITION BY z.c))::BIGINT AS cluster_inertia, (sum(z.d) OVER ())::BIGINT AS inertia, g.h AS centroid_sha256
FROM t JOIN z USING (r) JOIN g ON g.c = z.c
"""


ORACLE = _oracle(8, 10, 3, 64, 1024)
