"""Relational operators with the semantics the readers rely on."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most rows of a page.
PAGE_CEILING = 5000
_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)?")


def check_identifier(name: str) -> str:
    """A name that may stand in SQL text; anything else is refused."""
    if not _IDENTIFIER.fullmatch(name):
        raise ValueError(f"not an identifier: {name!r}")
    return name


def in_values(c: Column | str, values: Iterable) -> Column:
    """IN, where an empty list matches nothing."""
    values = list(values)
    return (F.col(c) if isinstance(c, str) else c).isin(*values) if values else F.lit(False)


def contains_any(term: str, *columns: str) -> Column:
    """Case-insensitive substring over several columns; wildcards in the term are ordinary characters."""
    pattern = "%" + re.sub(r"([\\%_])", r"\\\1", term) + "%"
    out = F.lit(False)
    for c in columns:
        out = out | F.col(c).ilike(pattern)
    return out


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page, with the columns position and truncated: whether there was more. Reads limit + 1 rows at most."""
    limit = min(limit, PAGE_CEILING)
    rows = df.orderBy(*order).offset(offset).limit(limit + 1)
    place = Window.partitionBy(F.lit(1)).orderBy(*order)
    rows = rows.withColumn("position", F.row_number().over(place).cast("long"))
    more = F.max("position").over(Window.partitionBy(F.lit(1))) > limit
    return rows.withColumn("truncated", more).where(F.col("position") <= limit)


def only_one(df: DataFrame) -> DataFrame:
    """df, which must not hold a second row; looks at two rows at most."""
    if df.limit(2).count() > 1:
        raise ValueError("more than one row")
    return df.limit(1)


def adaptive(df: DataFrame, wanted: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """The wanted columns that df has, and the names of those it lacks."""
    return df.select(*(c for c in wanted if c in df.columns)), [c for c in wanted if c not in df.columns]


def apply_filters(df: DataFrame, filters: dict[str, object]) -> tuple[DataFrame, list[str], list[str]]:
    """df under equality filters; (df, applied, ignored): a filter on a missing column is named, not dropped in silence."""
    applied = [c for c in filters if c in df.columns]
    for c in applied:
        df = df.where(F.col(c).eqNullSafe(F.lit(filters[c])))
    return df, applied, [c for c in filters if c not in df.columns]


def first_rows(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str | None = None) -> DataFrame:
    """First row of each group in an order of columns, `-column` for descending; `name` adds the group's size.

    One aggregate over structs, so a large group is reduced in each task before it is shuffled. Columns that go down
    must be numbers; nulls come first either way.
    """
    keys = [(-F.col(c[1:]) if c.startswith("-") else F.col(c)).alias(f"_{i}") for i, c in enumerate(order)]
    best = F.min(F.struct(*keys, F.struct(*(c for c in df.columns if c not in by)).alias("_row"))).alias("_best")
    out = df.groupBy(*by).agg(best, *([F.count("*").alias(name)] if name else []))
    return out.select(*by, "_best._row.*", *([name] if name else []))


#: Rows of a block; a larger group is cut into blocks, and two blocks meet in one tile.
BLOCK = 2000
#: The same where only keys are packed, and keys of a packed row.
KEYS, PACKED = 8000, 128
#: Most blocks of a group. A row goes into one tile more than its group has blocks, so copies grow no faster than the rows.
BLOCKS = 32
#: Comparisons of a task.
COMPARISONS = 20_000_000


def _work(sizes: DataFrame) -> float:
    """Comparisons within groups of _n rows."""
    return sizes.agg(F.sum(F.col("_n").cast("double") * F.col("_n") / 2)).first()[0] or 0


def _in_blocks(df: DataFrame, by: Sequence[str], key: str, block: int) -> tuple[DataFrame, float]:
    """df without null keys, with the number of blocks of each row's group (_blocks) and its own block (_own), and the number
    of comparisons. Blocks are ranges of the key, a number: keys of a lower block are less."""
    df = df.where(F.col(key).isNotNull()).dropna(subset=list(by))
    sizes = df.groupBy(*by).agg(F.count("*").alias("_n"))
    large = sizes.where(F.col("_n") > block).select(*by, F.least(F.lit(BLOCKS), F.ceil(F.col("_n") / block)).cast("int").alias("_blocks"))  # at most rows / block
    cuts = df.join(F.broadcast(large), list(by)).groupBy(*by, "_blocks").agg(F.percentile_approx(key, [k / BLOCKS for k in range(1, BLOCKS)], 1000).alias("_cuts"))
    cuts = cuts.withColumn("_cuts", F.expr(f"transform(sequence(1, _blocks - 1), k -> _cuts[k * {BLOCKS} div _blocks - 1])"))
    cuts = df.sparkSession.createDataFrame(cuts.collect(), cuts.schema)  # at most rows / block numbers; fixed, as both sides of a tile must be cut alike
    rows = df.join(F.broadcast(cuts), list(by), "left")
    own = F.when(F.col("_cuts").isNull(), 0).otherwise(F.size(F.filter("_cuts", lambda c: c <= F.col(key))))
    return rows.withColumns({"_own": own, "_blocks": F.coalesce("_blocks", F.lit(1))}).drop("_cuts"), _work(sizes)


def _meet(x: DataFrame, y: DataFrame, by: Sequence[str], work: float) -> DataFrame:
    """Rows x and y of every two blocks of a group, the lower one's as x, in a tile (_low, _high) of their own."""
    tile = [*by, "_low", "_high"]
    tasks = max(int(x.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(20_000, int(work / COMPARISONS)))
    x = x.withColumns({"_low": F.col("_own"), "_high": F.explode(F.sequence("_own", F.col("_blocks") - 1))}).drop("_own", "_blocks")
    y = y.withColumns({"_low": F.explode(F.sequence(F.lit(0), "_own")), "_high": F.col("_own")}).drop("_own", "_blocks")
    return x.repartition(tasks, *tile).join(y.repartition(tasks, *tile).hint("merge"), tile)


def pairs_within(df: DataFrame, by: Sequence[str], key: str) -> DataFrame:
    """(by, x, y) of every two rows of df that are alike in the columns `by`, where x's key is less; x and y are structs of
    the other columns. Nulls are alike to nothing.

    A group's rows fall into blocks by their key, and every two blocks meet in a tile of their own, so a large group is
    compared by many tasks with few rows each; their number follows that of the comparisons.
    """
    rows, work = _in_blocks(df, by, key, BLOCK)
    side = lambda name: rows.select(*by, "_blocks", "_own", F.struct(*(c for c in df.columns if c not in by)).alias(name))
    return _meet(side("x"), side("y"), by, work).where(F.col("x")[key] < F.col("y")[key]).drop("_low", "_high")


def keys_unlike(df: DataFrame, by: Sequence[str], key: str, unlike: str) -> DataFrame:
    """(by, a, b) of the keys a < b of every two rows of df that are alike in the columns `by` and differ in `unlike`.
    Nulls are neither alike nor different.

    Blocks and tiles as in pairs_within, but up to PACKED of a block's keys with one value of `unlike` share a row, and arrays
    meet in place of rows. So a stands still while b runs through the same few keys for each a: columnar files pack that best. Where
    most values have few keys, arrays are too short to save anything, and rows meet.
    """
    df = df.dropna(subset=[unlike])
    rows, work = _in_blocks(df, by, key, KEYS)
    packed = rows.groupBy(*by, "_blocks", "_own", unlike).agg(F.sort_array(F.collect_list(key)).alias("_keys"))
    parts = F.transform(F.sequence(F.lit(0), F.expr(f"int((size(_keys) - 1) div {PACKED})")), lambda i: F.slice("_keys", i * PACKED + 1, PACKED))
    packed = packed.withColumn("_keys", F.explode(parts))
    if 8 * _work(packed.groupBy(*by).agg(F.count("*").alias("_n"))) > work:
        p = pairs_within(df.select(*by, key, unlike), by, key).where(F.col("x")[unlike] != F.col("y")[unlike])
        return p.select(*by, F.col("x")[key].alias("a"), F.col("y")[key].alias("b"))
    side = lambda name: packed.select(*by, "_blocks", "_own", F.col(unlike).alias(f"_of_{name}"), F.col("_keys").alias(f"_{name}"))
    j = _meet(side("a"), side("b"), by, work).where("_of_a <> _of_b")
    # two parts of one block may overlap. A lambda isn't compiled with its neighbours, and it mustn't be: compiled in one piece
    # with the join, the explodes would hold all rows of an array's matches at once, and now hold those of two arrays
    j = j.select(*by, "_a", F.filter("_b", lambda b: b > F.col("_a")[0]).alias("_b"))
    return j.select(*by, F.explode("_a").alias("a"), "_b").select(*by, "a", F.explode("_b").alias("b")).where("a < b")


def resolve(names: DataFrame, aliases: DataFrame, owner: str) -> DataFrame:
    """(owner, anchor, verdict) of owners with names (owner, alias) over identifier spaces (priority, alias, anchor).

    The space of least priority in which one of the names means exactly one anchor decides. Names that mean several
    anchors are ambiguous, which is not the same as unknown.
    """
    meanings = aliases.groupBy("priority", "alias").agg(F.min("anchor").alias("anchor"), (F.min("anchor") == F.max("anchor")).alias("unique"))
    j = names.join(meanings, "alias", "left")
    best = F.min(F.when(F.col("unique"), F.struct("priority", "anchor")))["anchor"]
    verdict = F.when(F.bool_or(F.coalesce("unique", F.lit(False))), "resolved").when(F.count("priority") > 0, "ambiguous").otherwise("unknown")
    return j.groupBy(owner).agg(best.alias("anchor"), verdict.alias("verdict"))


def upsert_ignore(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First writer wins: new rows whose key old lacks are added."""
    fresh = new.dropDuplicates(list(keys)).join(old.select(*keys).distinct(), list(keys), "left_anti")
    return old.unionByName(fresh.select(*old.columns))


def upsert_update(old: DataFrame, new: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Last writer wins on the listed columns; the others keep their old values."""
    n = new.select(*keys, *(F.col(c).alias(f"_{c}") for c in new.columns if c not in keys), F.lit(True).alias("_is_new"))
    joined = old.join(n, list(keys), "full_outer")
    out = []
    for c in old.columns:
        if c in keys:
            out.append(F.col(c))
        elif c in columns:
            out.append(F.when(F.col("_is_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.coalesce(F.col(c), F.col(f"_{c}")).alias(c) if f"_{c}" in joined.columns else F.col(c))
    return joined.select(*out)


def merge_fill_only(old: DataFrame, new: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """NULLs of old are filled from new; values that differ stay, and their columns are listed in disagreements."""
    n = new.select(*keys, *(F.col(c).alias(f"_{c}") for c in columns))
    joined = old.join(n, list(keys), "left")
    differ = F.array_compact(F.array(*(F.when(F.col(c) != F.col(f"_{c}"), F.lit(c)) for c in columns)))
    filled = [F.coalesce(F.col(c), F.col(f"_{c}")).alias(c) if c in columns else F.col(c) for c in old.columns]
    return joined.select(*filled, differ.alias("disagreements"))


def rebuild_diff(stored: DataFrame, rebuilt: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows that a rebuild adds, loses or changes: (keys, kind, changed column names)."""
    a = stored.select(*keys, *columns, F.lit(True).alias("_in_a"))
    b = rebuilt.select(*keys, *(F.col(c).alias(f"_{c}") for c in columns), F.lit(True).alias("_in_b"))
    changed = F.array_compact(F.array(*(F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), F.lit(c)) for c in columns)))
    kind = F.when(F.col("_in_b").isNull(), "missing").when(F.col("_in_a").isNull(), "added").when(F.size("changed") > 0, "changed")
    out = a.join(b, list(keys), "full_outer").withColumn("changed", changed).withColumn("kind", kind)
    return out.where("kind IS NOT NULL").select(*keys, "kind", F.when(F.col("kind") == "changed", F.array_join("changed", ",")).otherwise("").alias("changed"))
