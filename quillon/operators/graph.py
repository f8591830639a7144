"""Combinatorial and graph-shaped operators of fixed depth."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.balance import NOT_A_POOL, POOL_UNDECLARED


def route_product(parts: DataFrame, roles: Sequence[int], part: str, role: str) -> DataFrame:
    """One part for every role in every combination, which is what is asked for; roles without parts give no routes."""
    out = None
    for r in roles:
        one = parts.where(F.col(role) == r).select(F.col(part).alias(f"part_{r}"))
        out = one if out is None else out.crossJoin(one)
    return out


#: Items that have no more subsets than a job can count (fixed by the width of a long).
MOST_ITEMS = 62


def power_set(items: DataFrame, item: str) -> DataFrame:
    """(subset, size) of all subsets, the empty one first, then by size and items. More than MOST_ITEMS are an error.

    The items are one short row; the subsets' bit masks are a range, so they are made where they are needed.
    """
    rows = items.agg(F.array_sort(F.collect_set(item)).alias("items"))
    n = len(rows.first()["items"])
    if n > MOST_ITEMS:
        raise ValueError(f"{n} items have too many subsets")
    masks = items.sparkSession.range(1 << n).withColumnRenamed("id", "mask").crossJoin(F.broadcast(rows))  # a single row
    subset = F.expr("filter(items, (x, i) -> shiftright(mask, i) & 1L = 1L)")
    return masks.select(subset.alias("subset")).select("subset", F.size("subset").alias("size")).orderBy("size", "subset")


def needs_supply(cofactor: Column, compartment: Column, pools: Mapping[str, Sequence[str]]) -> Column:
    """Whether a cofactor names a pool that the compartment isn't recorded as supplying."""
    known = F.create_map(*(x for c, names in pools.items() for x in (F.lit(c), F.array(*map(F.lit, names)))))
    has = F.array_contains(F.coalesce(F.element_at(known, compartment), F.array().cast("array<string>")), cofactor)
    return ~cofactor.isin(*NOT_A_POOL, *POOL_UNDECLARED) & ~has


def cofactor_demand(steps: DataFrame, pools: Mapping[str, Sequence[str]], optional: int) -> DataFrame:
    """(route_id, compartment, cofactor, demand, supplied): steps of a route that draw on a pool there, and whether the
    compartment is recorded as supplying it. Optional steps are the supply side and ask for nothing."""
    asks = steps.where((F.col("step_role") != optional) & ~F.col("cofactor").isin(*NOT_A_POOL, *POOL_UNDECLARED))
    out = asks.groupBy("route_id", "compartment", "cofactor").agg(F.count("*").alias("demand"))
    return out.withColumn("supplied", ~needs_supply(F.col("cofactor"), F.col("compartment"), pools))


def enumerate_routes(parts: DataFrame, strategies: DataFrame, roles: Sequence[int], optional: int, handoffs: Sequence[tuple[int, int]], carriers: DataFrame, pools: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """(route_id, strategy, parts, cycle, requirements, risks, gaps, balance_score, transport_score, feasibility): every part
    of each role x strategy x set of optional parts, gated and scored.

    parts are (part_id, step_role, cofactor); strategies (strategy, role, compartment, encoding, feasibility) place each
    role; carriers (source, target) are the known ones; pools are the cofactors that a compartment supplies. A role without
    parts is an error: an empty product would read as if no routes existed. The empty set of optional parts comes first
    and adds nothing to a route's id. A part carried in mitochondrial DNA must be recoded; a step whose cofactor its
    compartment doesn't supply is a risk; a handoff between compartments without a carrier is a gap; none excludes a
    route. The balance score falls with the risks, the transport score with the gaps. Without pools the risks weren't looked
    at: they and the balance score are null, never zero.
    """
    have = {r["step_role"] for r in parts.select("step_role").distinct().collect()}  # as many as there are roles
    if missing := [r for r in roles if r not in have]:
        raise ValueError(f"no part for role {', '.join(map(str, missing))}: the catalogue is incomplete")
    cofactor = F.col("cofactor") if "cofactor" in parts.columns else F.lit(None).cast("string").alias("cofactor")
    product = route_product(parts.withColumn("_part", F.struct("part_id", cofactor)), roles, "_part", "step_role")
    cycles = power_set(parts.where(F.col("step_role") == optional), "part_id").withColumnRenamed("subset", "cycle").select("cycle")
    placed = strategies.groupBy("strategy").agg(F.map_from_entries(F.collect_list(F.struct("role", F.struct("compartment", "encoding")))).alias("plan"), F.first("feasibility").alias("feasibility"))
    known = carriers.agg(F.collect_set(F.struct("source", "target")).alias("known"))  # a single row
    # gates are looked at once for parts and strategy, before the sets of optional parts multiply the rows
    routes = product.crossJoin(placed).crossJoin(F.broadcast(known))
    at = lambda role: F.element_at(F.col("plan"), F.lit(role))
    recode = F.array_compact(F.array(*(F.when(at(r)["encoding"] == "mitochondrial", F.concat(F.lit(f"recode role {r}: part "), F.col(f"part_{r}.part_id").cast("string"))) for r in roles)))
    risks = F.lit(None).cast("array<string>") if pools is None else F.array_compact(F.array(*(F.when(needs_supply(F.col(f"part_{r}.cofactor"), at(r)["compartment"], pools), F.concat_ws(" ", F.lit(f"role {r}:"), F.col(f"part_{r}.cofactor"), F.lit("in"), at(r)["compartment"])) for r in roles)))
    hops = [F.struct(at(a)["compartment"].alias("source"), at(b)["compartment"].alias("target")) for a, b in handoffs]
    gaps = F.array_compact(F.array(*(F.when((h["source"] != h["target"]) & ~F.array_contains("known", h), F.concat_ws(">", h["source"], h["target"])) for h in hops)))
    own = F.array(*(F.col(f"part_{r}.part_id") for r in roles))
    gated = routes.select("strategy", own.alias("parts"), recode.alias("requirements"), risks.alias("risks"), gaps.alias("gaps"), "feasibility")
    gated = gated.withColumns({"balance_score": 1.0 / (1 + F.size("risks")), "transport_score": 1.0 / (1 + F.size("gaps"))})
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), "+")
    route_id = F.concat(F.col("strategy"), F.lit(":"), text("parts"), F.when(F.size("cycle") > 0, F.concat(F.lit("+cycle:"), text("cycle"))).otherwise(""))
    return gated.crossJoin(cycles).select(route_id.alias("route_id"), "strategy", "parts", "cycle", "requirements", "risks", "gaps", "feasibility", "balance_score", "transport_score")


def ranked_routes(routes: DataFrame, fit: Mapping[str, float] | None = None) -> DataFrame:
    """routes with (place keys) in the order of rank: fewest gaps, then fewest risks, then feasibility, then fewest
    requirements, then id. With `fit`, a programme's wish for a strategy, that comes before feasibility; no fit counts 0.

    Never a weighted total. The order is a range-partitioned sort.
    """
    keys = [F.size("gaps").asc(), F.size("risks").asc()]
    if fit is not None:
        worth = F.create_map(*(F.lit(x) for pair in fit.items() for x in pair)) if fit else F.expr("map('', 0D)")
        keys.append(F.coalesce(F.element_at(worth, F.col("strategy")), F.lit(0.0)).desc())
    keys += [F.coalesce("feasibility", F.lit(0.0)).desc(), F.size("requirements").asc(), F.col("route_id").asc()]
    return routes.orderBy(*keys)


def insertion_plan(carried: DataFrame, loci: DataFrame) -> DataFrame:
    """(route_id, part, locus, leader, displaces, keeps_respiration, alternatives) for parts carried in mitochondrial DNA.

    The first free locus by name is offered; without one the first that has an activator, whose gene it displaces.
    alternatives counts the other loci that would cost a gene. Loci are a short list: (locus, leader, activators,
    displaces, free).
    """
    order = F.struct(F.when(F.col("free"), 0).otherwise(1).alias("cost"), "locus", "leader", "displaces", "free")
    usable = loci.where(F.col("free") | (F.size("activators") > 0))
    best = usable.agg(F.min(order).alias("site"), F.count_if(~F.col("free")).alias("costly"))
    out = carried.crossJoin(F.broadcast(best)).where("site IS NOT NULL")  # a single row
    free = F.col("site.free")
    return out.select("route_id", "part", F.col("site.locus").alias("locus"), F.col("site.leader").alias("leader"), F.when(~free, F.col("site.displaces")).alias("displaces"), free.alias("keeps_respiration"), (F.col("costly") - F.when(free, 0).otherwise(1)).alias("alternatives"))


def transport_gaps(steps: DataFrame, route: str, order: str, compartment: str, carriers: DataFrame) -> DataFrame:
    """(route, from, to) of consecutive steps in different compartments without a carrier (source, target)."""
    nxt = F.lead(compartment).over(Window.partitionBy(route).orderBy(order))
    hops = steps.withColumn("_to", nxt).where(F.col("_to").isNotNull() & (F.col("_to") != F.col(compartment)))
    hops = hops.select(route, F.col(compartment).alias("source"), F.col("_to").alias("target"))
    return hops.join(F.broadcast(carriers), ["source", "target"], "left_anti").select(route, "source", "target").distinct()


def relational_division(have: DataFrame, want: DataFrame, owner: str, item: str, wanted_by: str) -> DataFrame:
    """(wanted_by, owner) of owners that have every item of a wish list.

    Owners with the same items are one class, and so are wishes; only a class of owners with a wish's two rarest items and
    at least as many items as it is checked against its others. So what is compared grows with different sets, not with
    owners times wishes. Sizes meet in bands, a wish's own and those above it.
    """
    band = lambda c: F.floor(8 * F.log2(F.size(c))).cast("int")  # noqa: E731  # sizes within 9 % share a band
    sets = have.where(F.col(item).isNotNull()).groupBy(owner).agg(F.array_sort(F.collect_set(item)).alias("_items"))
    classes = sets.groupBy("_items").agg(F.count("*").alias("_size"))
    wishes = want.where(F.col(item).isNotNull()).groupBy(wanted_by).agg(F.array_sort(F.collect_set(item)).alias("_wish"))
    posts = classes.select("_items", "_size", F.explode("_items").alias("_item"))
    often = posts.groupBy("_item").agg(F.sum("_size").alias("_n"), F.max(band("_items")).alias("_top"))
    asked = wishes.select("_wish").distinct().select("_wish", F.explode("_wish").alias("_item"))
    order = F.array_sort(F.collect_list(F.struct("_n", "_item")))
    # an item that nobody has falls out of the join, and its wish with it; no class of an item is above its top band
    known = asked.join(often, "_item").groupBy("_wish").agg(F.slice(order, 1, 2)["_item"].alias("_key"), F.count("*").alias("_known"), F.min("_top").alias("_top"))
    known = known.where((F.col("_known") == F.size("_wish")) & (F.col("_top") >= band("_wish")))
    rarest = known.select("_wish", "_key", F.explode(F.sequence(band("_wish"), "_top")).alias("_band"))
    keys = rarest.select("_key", "_band").distinct().withColumns({"_item": F.col("_key")[0], "_second": F.try_element_at("_key", F.lit(2))})
    held = posts.withColumn("_band", band("_items")).join(keys, ["_item", "_band"]).where(F.col("_second").isNull() | F.array_contains("_items", F.col("_second"))).select("_key", "_band", "_items")
    got = rarest.join(held, ["_key", "_band"]).where((F.size("_wish") <= F.size("_items")) & (F.size(F.array_except("_wish", "_items")) == 0)).select("_wish", "_items")
    return wishes.join(got, "_wish").join(sets, "_items").select(wanted_by, owner)
