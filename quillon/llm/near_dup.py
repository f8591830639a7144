"""N-gram Jaccard join (operator 2): exact links between texts whose shingle sets are alike, and their components.

1.  Every text becomes a sorted set of shingle hashes and a hashed bitmap of about two bits a shingle. Equal sets, by 128
    bits of all their hashes, are one node. Texts without words are set apart; they link with nothing.
2.  Two sets can only be alike enough if they share a shingle among the first few of each in a common order. An order
    that puts frequent shingles last makes those keys rare. (Frequencies of a bounded sample set the order; any order
    gives the same links.) The nodes of a key that can still be alike, by their sizes and the key's place in the order,
    form the group that is named by the node of its smallest set, its hub.
3.  A group is laid out in tiles: by size band, and within a band by hash, so that no tile holds more nodes than it
    should. First every node stands in one group, that of its smallest hub, whose hub is in each tile. In a tile bit
    counts bound all overlaps from above; the pairs that they leave open are settled by intersecting the sorted arrays,
    best first, and pairs already in one component are left out, so a tile yields no more links than it has nodes.
4.  Then all groups are looked at whose nodes aren't one component by now: the nodes outside their hub's component meet
    their own tiles and, after that, in the groups that are still apart, the other tiles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.llm import shared
from quillon.llm.components import components
from quillon.llm.pretoken import mix
from quillon.llm.wordhash import chunks, shingle_sets

#: About so many documents are looked at for the order of shingles, in a sketch of so many counters (bits).
SAMPLE, SKETCH_BITS = 10_000, 22
#: Nodes that a tile takes of a band, and about how many shingles together.
TILE, TILE_SHINGLES = 128, 1 << 19
#: Words of 64 bits of the filter for nodes whose texts are needed (a fixed 4 MB); from so many nodes on it isn't used.
FILTER_BITS, FILTER_NODES = 19, 1 << 22
#: A shingle that 2**HOT of the sampled documents have is a hot key, whose group is summed up before it is shuffled.
HOT = 8
#: Tiles of at most so many nodes are compared pair by pair, larger ones node by node.
SMALL = 12


def _name(s: np.ndarray) -> bytes | None:
    """Name of a set: 128 bits that depend on all its hashes; None for the empty set.

    Two of N different sets share a name with a chance of about N**2 / 2**129.
    """
    if not len(s):
        return None
    low, high = np.add.reduce(mix(s)), np.add.reduce(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
    return mix(np.array([low + np.uint64(len(s)), high ^ np.uint64(len(s))])).tobytes()


def bitmap(s: np.ndarray) -> bytes:
    """Hashed bitmap; its width, a power of two, is the size band's: two to four bits a shingle."""
    bits = np.zeros(max(64, 1 << (2 * len(s) - 1).bit_length()), bool)
    bits[(s >> np.uint64(20) & np.uint64(len(bits) - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def fold(b: bytes, width: int) -> int:
    """A bitmap as an integer, folded to a smaller width (bytes)."""
    x, n = int.from_bytes(b, "little"), len(b)
    while n > width:
        n //= 2
        x = (x >> 8 * n) | (x & (1 << 8 * n) - 1)
    return x


def least_overlap(n: int, num: int, den: int) -> int:
    """Fewest shingles that a set of n must share with any set that is alike."""
    return -(-num * n // den)


def may_link(n1, n2, differing, num: int, den: int):
    """Whether sets of these sizes may be alike if `differing` bits differ: at least so many shingles aren't shared."""
    over = (n1 + n2 - differing) // 2  # at most so many are
    return den * over >= num * (n1 + n2 - over)


def _order_sketch(docs: DataFrame, k: int) -> np.ndarray:
    """Weight of a shingle by the top bits of its hash: about log2 of the sampled documents that have it, if four do.

    The sample is about SAMPLE documents at any size, so that the counters stay sparse.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for _, texts in chunks(batch.column(0)):
                for s in shingle_sets(texts, k):
                    np.add.at(total, (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["b", "n"])

    step = max(1, docs.count() // SAMPLE)
    sample = docs.where(F.pmod(F.xxhash64("id", F.length("text")), F.lit(step)) == 0).select("text")
    found = sample.mapInArrow(run, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).where("n >= 4").toArrow()  # at most 2**SKETCH_BITS rows
    weight = np.zeros(1 << SKETCH_BITS, np.uint8)
    if found.num_rows:
        weight[found["b"].to_numpy()] = np.log2(found["n"].to_numpy()).astype(np.uint8)
    return weight


def _sets(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(id, n, name, bitmap, keys, hot) of every document; bitmap and keys only where a task first meets a set.

    The first shingles in the common order are keys, then hot: those that many documents have come last.
    """
    kind = docs.schema["id"].dataType.simpleString()
    weights = docs.sparkSession.sparkContext.broadcast(_order_sketch(docs, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, seen = weights.value, set()
        for batch in batches:
            for first, texts in chunks(batch.column(1)):
                n, names, maps, keys, hot = [], [], [], [], []
                for s in shingle_sets(texts, k):
                    name = _name(s)
                    n.append(len(s))
                    names.append(name)
                    if name is None or name in seen:
                        for column in (maps, keys, hot):
                            column.append(None)
                        continue
                    if len(seen) >= 1 << 20:
                        seen.clear()
                    seen.add(name)
                    maps.append(bitmap(s))
                    own = weight[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                    first_few = np.argsort(own, kind="stable")[: len(s) - least_overlap(len(s), num, den) + 1]
                    often = own[first_few] >= HOT
                    keys.append(s[first_few[~often]].view(np.int64))
                    hot.append(s[first_few[often]].view(np.int64))
                lists = [pa.array(x, pa.list_(pa.int64())) for x in (keys, hot)]
                columns = [batch.column(0).slice(first, len(texts)), pa.array(n, pa.int64()), pa.array(names, pa.binary()), pa.array(maps, pa.binary()), *lists]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "name", "bitmap", "keys", "hot"])

    return shared.table(docs.mapInArrow(run, f"id {kind}, n long, name binary, bitmap binary, keys array<long>, hot array<long>"))


def _groups(nodes: DataFrame, num: int, den: int) -> DataFrame:
    """(hub, node, n) of the groups of two nodes or more, the hub being one of them.

    A rare key's nodes meet in one shuffle, in which its hub is looked up: the node of the smallest set, which
    all that stay can be alike with by their sizes. What is needed of a hot key is
    summed up before the shuffle and joined back by broadcast, so that a key which a third of all nodes have is no one
    task's. Two nodes that share a key share it in one of the two ways, as a key is hot for all or for none.

    A key's place says more than that it is shared: if it is the first that two sets have in common, they have at most the n
    - place shingles from there on, so a node only links through it with sets up to a certain size (`most`). Nodes whose
    `most` is below all sizes of the group, or whose size is above every other's `most`, leave it. A boilerplate
    passage, the last of the keys of texts that are too different otherwise, so makes no group.
    """

    def posts(column: str, before: str) -> DataFrame:
        at = nodes.select(F.posexplode(column).alias("place", "key"), "node", "n", F.expr(before).alias("before"))
        most = F.expr(f"({num + den} * (n - place - before)) div {num} - n").alias("most")
        return at.select("key", "node", "n", most)

    meets = (F.col("most") >= F.col("low")) & (F.col("n") <= F.col("top"))
    own = Window.partitionBy("key")
    rare = posts("keys", "0L")
    for _ in range(2):  # nodes that stay only because of some that leave go in the second turn
        rare = rare.withColumns({"low": F.min("n").over(own), "top": F.max("most").over(own)}).where(meets)
    rare = rare.withColumns({"hub": F.min_by("node", F.struct("n", "node")).over(own), "members": F.count("*").over(own)}).where("members > 1")
    often = posts("hot", "size(keys)")
    ends = often.groupBy("key").agg(F.min("n").alias("low"), F.max("most").alias("top"), F.count("*").alias("members")).where("members > 1")
    often = shared.table(shared.joined(often, shared.table(ends), ["key"], "members", "inner").where(meets).select("key", "node", "n"))
    hubs = often.groupBy("key").agg(F.min_by("node", F.struct("n", "node")).alias("hub"), F.count("*").alias("members")).where("members > 1")
    often = shared.joined(often, shared.table(hubs), ["key"], "members", "inner")
    return rare.select("hub", "node", "n").union(often.select("hub", "node", "n")).distinct()


def _tiled(members: DataFrame) -> DataFrame:
    """members with their tile: the size band and a part of it by hash, as many parts as the band needs."""
    band = F.floor(F.log2("n")).cast("int")
    room = F.greatest(F.lit(2), F.least(F.lit(TILE), F.expr(f"shiftright({TILE_SHINGLES}, band)")))
    m = members.withColumn("band", band)
    sizes = shared.table(m.groupBy("hub", "band").agg(F.count("*").alias("members")).withColumn("parts", F.ceil(F.col("members") / room)).where("parts > 1"))
    m = shared.joined(m, sizes, ["hub", "band"], "members")
    part = F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1)))
    return m.withColumn("tile", F.shiftleft(F.col("band").cast("long"), 40) + part).drop("band", "parts")


def _marks(names: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word and bit of each name in the filter."""
    x = np.frombuffer(b"".join(names), "<u8")[::2]
    return (x & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64), np.uint64(1) << (x >> np.uint64(58))


def _filter(wanted: DataFrame) -> np.ndarray | None:
    """Filter of names, of fixed size, so that strangers may pass but none is lost; None where it would be full."""
    if wanted.count() > FILTER_NODES:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(1 << FILTER_BITS, np.uint64)
        for batch in batches:
            if batch.num_rows:
                np.bitwise_or.at(words, *_marks(batch.column(0).to_pylist()))
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at].view(np.int64))], names=["i", "w"])

    found = wanted.mapInArrow(run, "i long, w long").groupBy("i").agg(F.expr("bit_or(w)").alias("w")).toArrow()  # at most 2**FILTER_BITS rows
    words = np.zeros(1 << FILTER_BITS, np.uint64)
    if found.num_rows:
        words[found["i"].to_numpy()] = np.array(found["w"].to_numpy()).view(np.uint64)
    return words


def _texts(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(name, text) of the sets named in a table (name) of distinct names, each once.

    Texts come from the documents once more, one per name and task. A filter spares most of the others the shuffle.
    """
    needed = docs.sparkSession.sparkContext.broadcast(_filter(wanted))

    def texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = needed.value, set()
        for batch in batches:
            for _, texts in chunks(batch.column(0)):
                names, kept = [], []
                found = [(x, t) for x, t in zip(map(_name, shingle_sets(texts, k)), texts) if x is not None and x not in seen]
                if found:
                    at, bit = _marks([x for x, _ in found])
                    hits = [True] * len(found) if words is None else (words[at] & bit != 0).tolist()
                    for (x, t), hit in zip(found, hits):
                        if hit and x not in seen:
                            if len(seen) >= 1 << 20:
                                seen.clear()
                            seen.add(x)
                            names.append(x)
                            kept.append(t)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(kept, pa.binary())], names=["name", "text"])

    found = docs.select("text").mapInArrow(texts_of, "name binary, text binary").groupBy("name").agg(F.first("text").alias("text"))
    return found.join(wanted, "name", "left_semi")


def alike(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    """Whether two sorted sets are alike, by intersecting them."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return den * both >= num * (len(x) + len(y) - both)


# ---------------------------------------------------------------- tiles

TILES = "hub long, t long, u long, side int, node long, n long, root long, name binary, bitmap binary"


def by_tile(handle: Callable[[pa.Table], pa.Table], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """handle of the rows of each tile pair (hub, t, u), whose rows follow each other; a tile pair is bounded."""
    held: list[pa.Table] = []

    def done() -> Iterator[pa.RecordBatch]:
        yield from handle(pa.concat_tables(held).combine_chunks()).to_batches()

    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        keys = np.stack([t[c].to_numpy() for c in ("hub", "t", "u")], 1)
        edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(t)]
        for a, b in zip(edges[:-1], edges[1:]):
            key = tuple(keys[a].tolist())
            if last is not None and key != last:
                yield from done()
                held = []
            held.append(t.slice(a, b - a))
            last = key
    if held:
        yield from done()


def open_pairs(table: pa.Table, num: int, den: int) -> Iterator[tuple[int, list[int], list[int]]]:
    """(row, rows on the other side that bit counts leave open and whose component differs, best first; components).

    Components are read anew for each row, so that whoever links two rows in the list of components spares the rest.
    """
    side, n, root = table["side"].to_pylist(), table["n"].to_pylist(), table["root"].to_pylist()
    maps = table["bitmap"].to_pylist()
    alone = 1 not in side
    left = [i for i, x in enumerate(side) if x == 0]
    right = left if alone else [i for i, x in enumerate(side) if x == 1]
    if len(left) + len(right) <= 2 * SMALL:
        folded: dict[tuple[int, int], int] = {}

        def bits(i: int, width: int) -> int:
            if (i, width) not in folded:
                folded[i, width] = fold(maps[i], width)
            return folded[i, width]

        for x, i in enumerate(left):
            found = []
            for j in right[x + 1 :] if alone else right:
                if root[i] != root[j] and n[j] * den >= n[i] * num and n[i] * den >= n[j] * num:
                    width = min(len(maps[i]), len(maps[j]))
                    differing = (bits(i, width) ^ bits(j, width)).bit_count()
                    if may_link(n[i], n[j], differing, num, den):
                        found.append((differing, j))
            if found:
                yield i, [j for _, j in sorted(found)], root
        return
    width = min(map(len, maps))
    grid = np.frombuffer(b"".join(fold(b, width).to_bytes(width, "little") for b in maps), "<u8").reshape(len(maps), -1)
    sizes, other = np.array(n), np.array(right)
    for x, i in enumerate(left):
        j = other[x + 1 :] if alone else other
        j = j[(np.array(root)[j] != root[i]) & (sizes[j] * den >= n[i] * num) & (n[i] * den >= sizes[j] * num)]
        differing = np.bitwise_count(grid[j] ^ grid[i]).sum(1).astype(np.int64)
        good = may_link(n[i], sizes[j], differing, num, den)
        if good.any():
            yield i, j[good][np.argsort(differing[good], kind="stable")].tolist(), root


def _tile_links(rows: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Links (a, b) that join components, from the rows of tile pairs (TILES).

    Bit counts are taken for all rows; only nodes that they leave open get their texts, once for each tile pair.
    """
    spark = docs.sparkSession

    def open_rows(table: pa.Table) -> pa.Table:
        some = np.zeros(len(table), bool)
        for i, others, _ in open_pairs(table, num, den):
            some[i] = True
            some[others] = True
        return table.filter(pa.array(some))

    def links(table: pa.Table) -> pa.Table:
        sets, node, a, b = shingle_sets(table["text"].to_pylist(), k), table["node"].to_pylist(), [], []
        for i, others, root in open_pairs(table, num, den):
            for j in others:
                if root[i] != root[j] and alike(sets[i], sets[j], num, den):
                    old, new = root[j], root[i]
                    root[:] = [new if x == old else x for x in root]
                    a.append(node[i])
                    b.append(node[j])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(shared.partitions(spark), "hub", "t", "u").sortWithinPartitions("hub", "t", "u", "side", "n", "node")

    left = shared.table(dealt(rows).mapInArrow(lambda x: by_tile(open_rows, x), TILES))
    if left.isEmpty():
        return spark.createDataFrame([], "a long, b long")
    wanted = shared.table(left.select("name").distinct())
    with_text = left.join(_texts(docs, wanted, k), "name").select(*left.columns, "text")
    return shared.table(dealt(with_text).mapInArrow(lambda x: by_tile(links, x), "a long, b long"))


def _first_tiles(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows of every tile with itself, and the group's hub in each tile."""
    fields = nodes.select("node", "name", "bitmap")
    tiles = members.groupBy("hub", "tile").agg(F.count("*").alias("members"), F.bool_or(F.col("node") == F.col("hub")).alias("has_hub"))
    guests = tiles.where("NOT has_hub").select("hub", "tile", F.col("hub").alias("node")).join(nodes.select("node", "n"), "node").select("hub", "node", "n", "tile")
    rows = members.select("hub", "node", "n", "tile").union(guests).join(fields, "node")
    return rows.select("hub", F.col("tile").alias("t"), F.col("tile").alias("u"), F.lit(0).alias("side"), "node", "n", F.col("node").alias("root"), "name", "bitmap")


def _later_tiles(members: DataFrame, nodes: DataFrame, found: DataFrame, num: int, den: int, across: bool) -> DataFrame:
    """Rows of the tile pairs of a group in which nodes that aren't in their hub's component meet their own tile or, across,
    all other tiles of the group.

    Groups of one component are left out before any bitmap travels.
    """
    m = shared.table(members.join(found, "node", "left").withColumn("root", F.coalesce("root", "node")).select("hub", "node", "n", "tile", "root"))
    home = F.max(F.when(F.col("hub") == F.col("node"), F.col("root"))).alias("home")
    apart = m.groupBy("hub").agg(home, F.min("root").alias("least"), F.max("root").alias("most"), F.count("*").alias("members")).where("least < most")
    m = shared.joined(m, shared.table(apart.select("hub", "home", "members")), ["hub"], "members", "inner")
    m = shared.table(m.withColumn("stranger", F.col("root") != F.col("home")))
    span = shared.table(m.groupBy("hub", "tile").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.count_if("stranger").alias("strangers")))
    x, y = span.where("strangers > 0").toDF("hub", "t", "low", "high", "strangers"), span.toDF("hub2", "u", "low2", "high2", "strangers2")
    tiles = F.col("t") != F.col("u") if across else F.col("t") == F.col("u")
    fits = (F.col("hub") == F.col("hub2")) & tiles & (F.col("high") * den >= F.col("low2") * num) & (F.col("high2") * den >= F.col("low") * num)
    meet = shared.table(x.join(y, fits).select("hub", "t", "u"))
    left = m.where("stranger").join(meet.withColumnRenamed("t", "tile"), ["hub", "tile"]).select("hub", F.col("tile").alias("t"), "u", F.lit(0).alias("side"), "node", "n", "root")
    right = m.join(meet.withColumnRenamed("u", "tile"), ["hub", "tile"]).select("hub", "t", F.col("tile").alias("u"), F.lit(1).alias("side"), "node", "n", "root")
    return left.union(right).join(nodes.select("node", "name", "bitmap"), "node").select("hub", "t", "u", "side", "node", "n", "root", "name", "bitmap")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row per document: (id, n_shingles, component_id) (operator 2).

    Texts are alike if den * intersection >= num * union of their sets of k-word shingles; A-Z is lower-cased and words
    are [^\\x20\\x09-\\x0D]+ of the whole text. A text with fewer than k words is one shingle; null, empty and
    wordless texts have none and link with nothing. component_id is the smallest id that links reach, itself
    included; null ids are passed over, and stand only where a component has no other. Repeated rows and ties are
    rows of their own; other columns, of any name, are not read; an empty table gives no rows. No link is lost: keys
    and bit counts only leave out pairs that cannot be alike. A very long text is a tile's rows like any other.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sets = _sets(rows, k, num, den)
    distinct = sets.where("bitmap is not null").groupBy("name").agg(F.first("n").alias("n"), F.first("bitmap").alias("bitmap"), F.first("keys").alias("keys"), F.first("hot").alias("hot"))
    nodes = shared.table(distinct.withColumn("node", F.monotonically_increasing_id()))
    groups = shared.table(_groups(nodes, num, den))
    first = shared.table(_tiled(groups.groupBy("node").agg(F.min("hub").alias("hub"), F.first("n").alias("n"))))
    links = _tile_links(_first_tiles(first, nodes), rows, k, num, den)
    found = components(links)
    members = shared.table(_tiled(groups))
    for across in (False, True):
        more = _tile_links(_later_tiles(members, nodes, found, num, den, across), rows, k, num, den)
        if not more.isEmpty():
            found = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
    least = sets.where("name is not null").groupBy("name").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    rooted = least.join(nodes.select("name", "node"), "name").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = shared.table(rooted.select("name", "root", "least", "copies"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("names"))
    named = shared.table(shared.joined(rooted, named, ["root"], "names").select("name", "component_id", "copies"))
    worded = shared.joined(sets.where("name is not null").select("id", "n", "name"), named, ["name"], "copies").select("id", "n", "component_id")
    out = worded.union(sets.where("name is null").select("id", "n", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs whose id is their component's id, with all columns; rows without an id stay, for want of a name.

    Ids name documents: rows that share an id stay or go together. Null, empty and wordless texts stay; other columns may
    have any names; an empty table gives no rows.
    """
    gone = shared.free_name(docs.columns, "gone")
    out = near_groups(docs, id_col, text_col, k, num, den).where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias(gone)).distinct()
    return docs.join(out, docs[id_col] == out[gone], "left_anti")


ORACLE = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i, any_value(a.n) AS n1, any_value(b.n) AS n2
  FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id AND a.n * 100 >= b.n * 80 AND b.n * 100 >= a.n * 80 GROUP BY ALL),
l AS (SELECT x, y FROM c WHERE 100 * i >= 80 * (n1 + n2 - i)),
u AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, m) AS (SELECT doc_id, doc_id FROM s UNION SELECT u.y, r.m FROM r JOIN u ON r.doc_id = u.x WHERE r.m < u.y)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, k.component_id
FROM s JOIN (SELECT doc_id, min(m) AS component_id FROM r GROUP BY doc_id) k ON s.doc_id = k.doc_id
"""
