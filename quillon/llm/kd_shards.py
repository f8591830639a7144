"""K-d tree sharding (operator 13); DataFrame functions only.

Rows are points of metadata dimensions. A node that holds several shards is split along the dimension in which its rows
spread most, at the weighted median of bytes (the weighted quantile, where the shards don't halve), until a leaf is one
shard's bytes. Rows with the same place on the dimension follow the digest of their text, so that equal texts stay
together unless they alone are too much for a shard.

The tree has as many nodes as shards and is all that the driver holds. All nodes of a level find their medians together: a
job sums bytes in BINS bins of each node's keys and gives each bin's least and greatest key; the bin in which the median
lies is divided again, until it is a single key. A row's node is one nested expression over the cuts, so nothing is
written, sorted or shuffled for a level but the sums.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm import shared

#: Bins of a node's keys that a job sums.
BINS = 1024
#: Rows of one key stay together if they hold less than this part of a shard.
WHOLE = 64
#: Numbers of a dimension saturate here.
SPAN = 1 << 61
#: About so many rows are numbered in one group; so many groups may be split further because their keys are hot.
GROUP, HOT_GROUPS = 4096, 1000


@dataclass
class Node:
    """A node with the shards from `first` on, as many as `shards`; `cut` are the least rows' keys that go right."""

    first: int
    shards: int
    name: int
    keys: list[str] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    #: Whether rows with exactly the cut's keys go left.
    left_has_cut: bool = False
    children: list[Node] = field(default_factory=list)


def goes_left(node: Node) -> str:
    """SQL: whether a row's keys come before the node's cut."""
    out = str(node.left_has_cut)
    for key, value in reversed(list(zip(node.keys, node.cut))):
        out = f"({key} < {value}L OR ({key} = {value}L AND {out}))"
    return out


def at_leaf(node: Node, value: Callable[[Node], str]) -> str:
    """SQL: value of the leaf that a row falls in; each cut stands once."""
    if not node.children:
        return value(node)
    left, right = node.children
    return f"CASE WHEN {goes_left(node)} THEN {at_leaf(left, value)} ELSE {at_leaf(right, value)} END"


def with_leaf(rows: DataFrame, root: Node, value: Callable[[Node], str], *columns: str) -> DataFrame:
    """columns, and the fields of a leaf's struct, of the rows where it isn't null.

    The struct comes out of a generator, so that no later expression repeats the tree.
    """
    return rows.selectExpr(*columns, f"explode(array({at_leaf(root, value)})) AS leaf").where("leaf IS NOT NULL").select("*", "leaf.*").drop("leaf")


def place_of_text(text: Column) -> Column:
    """A text's place: the number of its first seven UTF-8 bytes, -1 for null. Sorts as the texts do, up to there."""
    return F.coalesce(F.conv(F.rpad(F.substring(F.hex(F.encode(text, "UTF-8")), 1, 14), 14, "0"), 16, 10).cast("long"), F.lit(-1).cast("long"))


def digest(text: Column) -> Column:
    """60 bits of a text's md5."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def points(docs: DataFrame, dims: tuple[str, ...], id_col: str, text_col: str) -> DataFrame:
    """(uid, id, size, text_crc32, d0, d1, ..., h_text, h_row) of the rows, written to the shared folder."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = (F.octet_length(text) + 8).cast("long")
    places = []
    for i, d in enumerate(dims):
        c = size if d == "bytes" else F.col(f"`{d}`")
        kind = T.LongType() if d == "bytes" else docs.schema[d].dataType
        whole = isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType))
        number = F.greatest(F.lit(-SPAN), F.least(F.lit(SPAN), c.cast("long")))
        places.append((F.coalesce(number, F.lit(-SPAN - 1).cast("long")) if whole else place_of_text(c.cast("string"))).alias(f"d{i}"))
    h_text = F.coalesce(digest(F.col(text_col)), F.lit(-1).cast("long"))
    h_row = digest(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit("|"), F.md5(text)))
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), size.alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), *places, h_text.alias("h_text"), h_row.alias("h_row"))
    return shared.table(rows)


def choose(before: int, here: int, target: int) -> bool:
    """Whether a key's bytes go left, by the nearer edge; before them if both are as near."""
    return before + here - target < target - before


def split(rows: DataFrame, nodes: list[Node], root: Node, spans: dict[str, int]) -> None:
    """Cut nodes of one level: sets their keys, cut and children. rows are points; spans are the root's by dimension."""
    dims = list(spans)
    wanted = {n.name for n in nodes}
    at = with_leaf(rows, root, lambda n: f"named_struct('node', {n.name})" if n.name in wanted else "NULL", "size", *dims)
    extents = at.groupBy("node").agg(F.sum("size").alias("bytes"), *(f(d).alias(f"{f.__name__}_{d}") for d in dims for f in (F.min, F.max)))
    found = {r.node: r for r in extents.collect()}  # a row for each node
    state = {}
    for n in nodes:
        r = found.get(n.name)
        if r is None:  # no rows: nothing to cut
            continue
        widest = max(dims, key=lambda d: (r[f"max_{d}"] - r[f"min_{d}"]) / spans[d] if spans[d] else 0.0)
        n.keys = [widest]
        state[n.name] = {"node": n, "low": r[f"min_{widest}"], "high": r[f"max_{widest}"], "before": 0, "target": r.bytes * (n.shards // 2) // n.shards, "share": r.bytes // n.shards}
    further = ["h_text", "h_row", "uid"]
    while state:

        def binned(n: Node) -> str:
            if n.name not in state:
                return "NULL"
            s, key = state[n.name], n.keys[-1]
            mine = " AND ".join([f"{key} BETWEEN {s['low']}L AND {s['high']}L", *(f"{k} = {v}L" for k, v in zip(n.keys, n.cut))])
            width = (s["high"] - s["low"]) // BINS + 1
            return f"CASE WHEN {mine} THEN named_struct('node', {n.name}, 'bin', ({key} - {s['low']}L) div {width}L, 'k', {key}) END"

        k = with_leaf(rows, root, binned, "size")
        sums = k.groupBy("node", "bin").agg(F.sum("size").alias("bytes"), F.min("k").alias("low"), F.max("k").alias("high"))
        bins: dict[int, list] = {}
        for r in sums.collect():  # at most BINS rows a node
            bins.setdefault(r.node, []).append(r)
        for name, s in list(state.items()):
            n = s["node"]
            for r in sorted(bins[name], key=lambda r: r.bin):
                if s["before"] + r.bytes > s["target"]:  # true of a bin: a target is less than all bytes
                    break
                s["before"] += r.bytes
            if r.low < r.high:
                s["low"], s["high"] = r.low, r.high
                continue
            n.cut.append(r.low)
            if r.bytes * WHOLE <= s["share"] or n.keys[-1] == "uid":
                n.left_has_cut = choose(s["before"], r.bytes, s["target"])
                del state[name]
                continue
            n.keys.append(further[len(n.keys) - 1])
            s["low"], s["high"] = (0 if n.keys[-1] == "uid" else -1), (1 << 63) - 1 if n.keys[-1] == "uid" else 1 << 60
    for n in nodes:
        left = n.shards // 2
        n.children = [Node(n.first, left, 2 * n.name), Node(n.first + left, n.shards - left, 2 * n.name + 1)]


def tree(rows: DataFrame, dims: list[str], shards: int) -> Node:
    """The tree over the points, one level of nodes after the other."""
    root = Node(0, shards, 1)
    ends = rows.agg(*(f(d).alias(f"{f.__name__}_{d}") for d in dims for f in (F.min, F.max))).first()
    spans = {d: (ends[f"max_{d}"] or 0) - (ends[f"min_{d}"] or 0) for d in dims}
    level = [root]
    while level := [n for n in level if n.shards > 1]:
        split(rows, level, root, spans)
        level = [c for n in level for c in n.children]
    return root


def shard(docs: DataFrame, shards: int = 24, dims: tuple[str, ...] = ("source", "lang", "bytes"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (id, size, text_crc32, law, shard, slot, grown_shard) (operator 13); law is `bytes`.

    Sizes are UTF-8 bytes plus 8; a null text has none, so 8, and the checksum of the empty text. dims name columns of
    numbers or strings, or `bytes` for the size; strings count by
    their first seven bytes, numbers up to 2**61; a null is a place of its own, before the others. Shards are even in
    bytes up to half a row, or half a group of equal texts with equal place that holds at most a 64th of a shard, for each
    of the tree's cuts; larger groups are cut by digests of id and text, and repeated rows, which nothing tells apart,
    between them. Slots follow the digest of id and text. With fewer rows than shards some shards are empty; an empty
    table gives no rows. Other columns, of any name, are not read. grown_shard is null, as is due for this law.
    """
    rows = points(docs, dims, id_col, text_col)
    root = tree(rows, [f"d{i}" for i in range(len(dims))], shards)
    groups = max(1, rows.count() // (GROUP * shards))
    group = f"h_row div {(1 << 60) // groups + 1}L AS g"
    placed = with_leaf(rows, root, lambda n: f"named_struct('shard', {n.first})", "id", "uid", "size", "text_crc32", "h_row", group)
    hot = placed.groupBy("g").count().where(F.col("count") > 8 * GROUP * shards).orderBy(F.desc("count")).limit(HOT_GROUPS).collect()
    salt = F.when(F.col("g").isin([r.g for r in hot]), F.expr("shiftright(uid, 33)")).otherwise(0)  # few keys with very many rows: by the task that read them
    placed = placed.withColumn("salt", salt.cast("long"))
    before = Window.partitionBy("shard").orderBy("g", "salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "g", "salt").agg(F.count("*").alias("rows"))
    starts = starts.select("shard", "g", "salt", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    here = Window.partitionBy("shard", "g", "salt").orderBy("h_row", "uid")
    out = placed.withColumn("nth", F.row_number().over(here)).join(starts, ["shard", "g", "salt"])
    slot = (F.col("start") + F.col("nth") - 1).cast("long")
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def _oracle(shards: int, dims: tuple[str, ...] = ("source", "lang", "bytes")) -> str:
    """The same in DuckDB SQL: windows over each level's nodes instead of sums in bins."""
    place = lambda d: "size" if d == "bytes" else f"coalesce(('0x' || rpad(substr(hex(encode({d})), 1, 14), 14, '0'))::BIGINT, -1)"
    parts = [
        """tab AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM range(256) x(i)))""",
        """a AS (SELECT row_number() OVER () AS uid, doc_id, source, lang, text, coalesce(text, '') AS full_text, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) + 8 AS size FROM documents)""",
        f"""p0 AS MATERIALIZED (SELECT uid, doc_id, size, {", ".join(f"{place(d)} AS d{i}" for i, d in enumerate(dims))}, coalesce(('0x' || substr(md5(text), 1, 15))::BIGINT, -1) AS h_text,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || '|' || md5(full_text)), 1, 15))::BIGINT AS h_row,
  xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(x, '..'), lambda i: ('0x' || i)::BIGINT)), lambda c, y: xor(t[(xor(c, y) & 255) + 1], c >> 8))) AS crc,
  0 AS first, {shards} AS shards FROM a, tab)""",
        f"s AS (SELECT {', '.join(f'nullif(max(d{i}) - min(d{i}), 0) AS s{i}' for i in range(len(dims)))} FROM p0)",
    ]
    kept, orders, at, most = "uid, doc_id, size, h_text, h_row, crc, " + ", ".join(f"d{i}" for i in range(len(dims))), ["k", "k, h_text", "k, h_text, h_row", "k, h_text, h_row, uid"], 0, shards
    while most > 1:
        spread = ", ".join(f"coalesce((max(d{i}) - min(d{i}))::DOUBLE / any_value(s{i})::DOUBLE, 0)" for i in range(len(dims)))
        parts.append(f"w{at} AS (SELECT first, shards, sum(size)::BIGINT AS w, list_position([{spread}], list_max([{spread}])) AS dim FROM p{at}, s WHERE shards > 1 GROUP BY first, shards)")
        parts.append(f"k{at} AS (SELECT p.*, CASE w.dim {' '.join(f'WHEN {i + 1} THEN d{i}' for i in range(len(dims)))} END AS k, w.w * (p.shards // 2) // p.shards AS t, w.w // p.shards AS share FROM p{at} p LEFT JOIN w{at} w USING (first, shards))")
        sums = ", ".join(f"(sum(size) OVER (PARTITION BY first, shards ORDER BY {o}))::BIGINT AS a{i}, (sum(size) OVER (PARTITION BY first, shards, {o}))::BIGINT AS b{i}" for i, o in enumerate(orders))
        parts.append(f"c{at} AS (SELECT *, {sums} FROM k{at})")
        side = " ".join(f"WHEN a{i} <= t THEN true WHEN a{i} - b{i} > t THEN false WHEN b{i} * {WHOLE} <= share OR {i} = 3 THEN 2 * a{i} - b{i} < 2 * t" for i in range(4))
        parts.append(f"l{at} AS (SELECT *, CASE WHEN shards = 1 THEN NULL {side} END AS l FROM c{at})")
        parts.append(f"p{at + 1} AS MATERIALIZED (SELECT {kept}, CASE WHEN l OR l IS NULL THEN first ELSE first + shards // 2 END AS first, CASE WHEN l IS NULL THEN 1 WHEN l THEN shards // 2 ELSE shards - shards // 2 END AS shards FROM l{at})")
        at, most = at + 1, most - most // 2
    return "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, size, crc AS text_crc32, 'bytes' AS law, first::INTEGER AS shard, row_number() OVER (PARTITION BY first ORDER BY h_row, uid) - 1 AS slot, NULL::INTEGER AS grown_shard FROM p{at}
"""


ORACLE = _oracle(24)
