"""Conservation of reactions and redox balance of routes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of the pools' reduced cofactors, and preferences that name no pool.
REDUCED_OF_POOL = {"nad": "NADH", "nadp": "NADPH"}
NOT_A_POOL = ("NA",)
POOL_UNDECLARED = ("unknown", "either")
#: Ways in which a reaction may fail to conserve.
PROBLEMS = ("undeclared", "carbon", "nad redox", "nadp redox", "redox carriers", "adenylate")


def conservation(participants: DataFrame, metabolites: DataFrame, reactions: DataFrame) -> DataFrame:
    """(reaction_id, problems, the signed counts) of every reaction, balanced or not.

    participants are (reaction_id, metabolite_id, role, coefficient), metabolites (metabolite_id, carbons, pair, redox,
    adenylate), reactions (reaction_id, transfers). One aggregate keeps the counts of both sides: carbons; reduced
    and oxidised members of either pool; charged adenylate in and discharged out. What goes in reduced must come out oxidised
    in its own pool, unless the reaction is declared to transfer between pools; carriers are conserved in any case. A
    participant that no metabolite declares is a problem of its own. Roles other than substrate and product have
    no side. All problems are listed, in the order of PROBLEMS. Carbons that aren't known count 0.
    """
    known = metabolites.select("metabolite_id", "carbons", "pair", "redox", "adenylate", F.lit(True).alias("declared"))
    j = participants.where("role IN ('substrate', 'product')").join(known, "metabolite_id", "left")
    side = {"in": F.col("role") == "substrate", "out": F.col("role") == "product"}

    def total(where: Column, what: Column | None = None) -> Column:
        return F.coalesce(F.sum(F.when(where, F.col("coefficient") if what is None else what)), F.lit(0.0))

    counts = {"undeclared": F.count_if(F.col("declared").isNull())}
    for s, here in side.items():
        counts[f"carbon_{s}"] = total(here, F.coalesce("carbons", F.lit(0)) * F.col("coefficient"))
        for pool in REDUCED_OF_POOL:
            for state in ("reduced", "oxidized"):
                counts[f"{pool}_{state}_{s}"] = total(here & (F.col("pair") == pool) & (F.col("redox") == state))
    counts["charged_in"] = total(side["in"] & (F.col("adenylate") == "charged"))
    counts["discharged_out"] = total(side["out"] & (F.col("adenylate") == "discharged"))
    sums = j.groupBy("reaction_id").agg(*(c.alias(name) for name, c in counts.items()))
    r = reactions.select("reaction_id", F.coalesce("transfers", F.lit(False)).alias("transfers")).join(sums, "reaction_id", "left").na.fill(0, list(counts))
    c = F.col
    own_pool = {p: ~c("transfers") & ((c(f"{p}_reduced_in") != c(f"{p}_oxidized_out")) | (c(f"{p}_oxidized_in") != c(f"{p}_reduced_out"))) for p in REDUCED_OF_POOL}
    carriers = {s: sum((c(f"{p}_{state}_{s}") for p in REDUCED_OF_POOL for state in ("reduced", "oxidized")), F.lit(0.0)) for s in side}
    tests = [c("undeclared") > 0, c("carbon_in") != c("carbon_out"), own_pool["nad"], own_pool["nadp"], carriers["in"] != carriers["out"], c("charged_in") != c("discharged_out")]
    problems = F.array_compact(F.array(*(F.when(t, F.lit(p)) for t, p in zip(tests, PROBLEMS))))
    return r.select("reaction_id", "transfers", problems.alias("problems"), *counts)


def reduced_equivalents(participants: DataFrame, metabolites: DataFrame) -> DataFrame:
    """(reaction_id, pools, undirected): net reduced equivalents that a reaction makes (+) or spends (-), by pool, and
    the reduced participants whose role has no direction. Only the reduced member counts: both would always sum to zero."""
    m = metabolites.where("redox = 'reduced' AND pair IS NOT NULL").select("metabolite_id", "name", "pair")
    sign = F.when(F.col("role") == "product", 1.0).when(F.col("role") == "substrate", -1.0)
    by_pool = participants.join(m, "metabolite_id").groupBy("reaction_id", "pair").agg(F.sum(sign * F.col("coefficient")).alias("net"), F.collect_list(F.when(sign.isNull(), F.col("name"))).alias("names"))
    pools = F.array_sort(F.collect_list(F.when(F.coalesce("net", F.lit(0.0)) != 0, F.struct(F.col("pair").alias("pool"), "net"))))
    return by_pool.groupBy("reaction_id").agg(pools.alias("pools"), F.array_sort(F.flatten(F.collect_list("names"))).alias("undirected"))


def step_contributions(steps: DataFrame, reactions: DataFrame, equivalents: DataFrame, names: Mapping[str, str] = REDUCED_OF_POOL) -> DataFrame:
    """steps with (terms, unknown, substitution): what each adds to its compartment's pools, or why that isn't known.

    steps are (route_id, pathway_id, step_role, part_id, compartment, cofactor, genes); reactions (reaction_id,
    pathway_id, step_role, genes, transfers). Size and sign come from the reaction, the compartment from the route and
    the pool from the part, which is recorded where it is not the reaction's. Of several reactions of a role the one that
    shares a gene with the part is meant, if it is the only one; else they must agree. A transfer keeps its own pools and
    must sum to zero. Reactions are summed up by role and by gene before steps meet them, so a role with very many
    reactions costs its steps no more than one row.
    """
    r = reactions.join(equivalents, "reaction_id", "left")
    pools = F.coalesce("pools", F.expr("CAST(array() AS array<struct<pool: string, net: double>>)"))
    r = r.withColumn("one", F.struct("reaction_id", pools.alias("pools"), F.coalesce("undirected", F.array().cast("array<string>")).alias("undirected"), F.coalesce("transfers", F.lit(False)).alias("transfers")))
    role = ["pathway_id", "step_role"]
    by_role = r.groupBy(*role).agg(F.count("*").alias("candidates"), F.min("one").alias("first"), F.max(F.when(F.size("one.undirected") > 0, True)).alias("some_undirected"), (F.min("one.pools") != F.max("one.pools")).alias("differ"))
    by_gene = r.select(*role, F.explode(F.transform("genes", F.lower)).alias("gene"), "one").groupBy(*role, "gene").agg(F.min("one").alias("low"), F.max("one.reaction_id").alias("high"))
    key = ["route_id", "step_role", "part_id", "compartment"]
    s = steps.join(by_role, role, "left")
    several = s.where("candidates > 1").select(*key, "pathway_id", F.explode(F.transform("genes", F.lower)).alias("gene"))
    hits = several.join(by_gene, [*role, "gene"]).groupBy(*key).agg(F.min("low").alias("low"), F.max("high").alias("high"))
    s = s.join(hits.where("low.reaction_id = high").select(*key, F.col("low").alias("only")), key, "left")
    reaction = F.coalesce("only", "first")
    narrowed = F.col("only").isNotNull()
    s = s.withColumn("reaction", reaction)
    known = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    named = F.transform("reaction.pools", lambda p: F.struct(F.element_at(known, p["pool"]).alias("cofactor"), p["net"].alias("net")))
    s = s.withColumn("named", named)
    first = F.col("named")[0]
    wanted, count = F.col("cofactor"), F.size("named")
    moved = F.aggregate("named", F.lit(0.0), lambda a, p: a + p["net"])
    undirected = F.when(narrowed, F.size("only.undirected") > 0).otherwise(F.coalesce("some_undirected", F.lit(False)))
    transfers = F.col("reaction.transfers")
    reasons = [
        (F.col("candidates").isNull(), "no reaction"),
        (undirected, "no direction"),
        (~narrowed & F.col("differ"), "reactions disagree"),
        (F.exists("named", lambda p: p["cofactor"].isNull()), "pool without a name"),
        (transfers & (moved != 0), "transfer does not conserve"),
        (~transfers & (count == 0) & ~wanted.isin(*NOT_A_POOL), "amount not recorded"),
        (~transfers & (count > 0) & wanted.isin(*POOL_UNDECLARED), "pool not recorded"),
        (~transfers & (count > 0) & wanted.isin(*NOT_A_POOL), "part and pathway disagree"),
        (~transfers & (count > 1), "two pools"),
    ]
    unknown = F.lit(None).cast("string")
    for test, reason in reversed(reasons):
        unknown = F.when(test, F.lit(reason)).otherwise(unknown)
    s = s.withColumn("unknown", unknown)
    own = F.array(F.struct(wanted.alias("cofactor"), first["net"].alias("net")))
    terms = F.when(F.col("unknown").isNotNull() | (count == 0), F.slice("named", 1, 0)).when(transfers, F.col("named")).otherwise(own)
    changed = F.col("unknown").isNull() & ~transfers & (count == 1) & (wanted != first["cofactor"])
    substitution = F.when(changed, F.concat(first["cofactor"], F.lit(" to "), wanted))
    return s.select(*steps.columns, terms.alias("terms"), "unknown", substitution.alias("substitution"))


def redox_balance(steps: DataFrame, reactions: DataFrame, participants: DataFrame, metabolites: DataFrame) -> DataFrame:
    """(route_id, status, open_buckets, unknowns, substitutions) of every route.

    Terms are summed for each compartment and pool, never across them. A route with any step that isn't known is
    unknown, whatever its sums; with an open bucket it is unbalanced; else balanced. Open buckets are (compartment, cofactor,
    net), heaviest first; unknowns are (step_role, part_id, reason), substitutions (step_role, part_id, change).
    """
    s = step_contributions(steps, reactions, reduced_equivalents(participants, metabolites))
    why = F.when(F.col("unknown").isNotNull(), F.struct("step_role", "part_id", F.col("unknown").alias("reason")))
    swap = F.when(F.col("substitution").isNotNull(), F.struct("step_role", "part_id", F.col("substitution").alias("change")))
    rows = s.select("route_id", "compartment", why.alias("why"), swap.alias("swap"), F.explode_outer("terms").alias("t"))
    # a step has several terms only as a transfer, which has neither reason nor substitution; so neither repeats
    by_bucket = rows.groupBy("route_id", "compartment", F.col("t.cofactor").alias("cofactor")).agg(F.sum("t.net").alias("net"), F.collect_list("why").alias("why"), F.collect_list("swap").alias("swap"))
    bucket = F.when(F.col("net") != 0, F.struct((-F.abs("net")).alias("weight"), "compartment", "cofactor", "net"))
    by_route = by_bucket.groupBy("route_id").agg(F.array_sort(F.collect_list(bucket)).alias("buckets"), F.array_sort(F.flatten(F.collect_list("why"))).alias("unknowns"), F.array_sort(F.flatten(F.collect_list("swap"))).alias("substitutions"))
    status = F.when(F.size("unknowns") > 0, "unknown").when(F.size("buckets") > 0, "unbalanced").otherwise("balanced")
    open_buckets = F.transform("buckets", lambda b: F.struct(b["compartment"].alias("compartment"), b["cofactor"].alias("cofactor"), b["net"].alias("net")))
    return by_route.select("route_id", status.alias("status"), open_buckets.alias("open_buckets"), "unknowns", "substitutions")
