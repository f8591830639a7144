"""Literature recall: which enumerated routes agree with what a paper's configuration names."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A designation mixes letters and digits and is at most so long (fixed by how variants are written).
DESIGNATION_MAX = 16
#: Clauses of a verdict in the order in which they are tried.
CLAUSES = ("strategy_not_enumerable", "host_not_recorded", "host_outside_enumeration", "no_enzyme_set_recorded", "matched", "catalog_gap", "source_organism_ambiguous", "variant_designation_ambiguous", "under_specified")


def tokens(text: str | Column) -> Column:
    """Lower-cased names: runs of letters and digits that begin with a letter."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("(?<![a-z0-9])[a-z][a-z0-9]*"), F.lit(0)))


def designations(text: str | Column) -> Column:
    """Lower-cased runs of letters and digits that have both, and pairs of neighbouring runs as one; not too long."""
    runs = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    pairs = F.zip_with(F.slice(runs, 1, F.greatest(F.size(runs) - 1, F.lit(0))), F.slice(runs, 2, F.greatest(F.size(runs) - 1, F.lit(0))), lambda a, b: F.concat(a, b))
    fits = lambda x: x.rlike("[a-z]") & x.rlike("[0-9]") & (F.length(x) <= DESIGNATION_MAX)
    return F.array_distinct(F.filter(F.concat(runs, pairs), fits))


def organism(text: str | Column) -> tuple[Column, Column]:
    """(genus or its initial, species) after `from`, lower-cased; empty where none is named."""
    pattern = r"from ([A-Z](?:[a-z]+|\.)) ([a-z]{2,})"
    return F.lower(F.regexp_replace(F.regexp_extract(text, pattern, 1), r"\.", "")), F.regexp_extract(text, pattern, 2)


def resolve_roles(entries: DataFrame, parts: DataFrame, aliases: Mapping[str, str], role_tokens: Mapping[str, int], family_tokens: Sequence[str]) -> DataFrame:
    """(config_id, entry, outcome, role, part_ids) of every different entry, a row for each role it fills.

    entries are (config_id, entry), parts (part_id, step_role, genes, designations, organism). Names are compared
    whole, never as parts of others. A gene that several parts carry stays ambiguous, unless the entry names a variant
    that exactly one of them has; two with it are refused (`ambiguous_variant`). An entry without a known gene that
    names one role and an organism resolves if exactly one part is of both; two are refused (`ambiguous_source`). Else it
    only names a role (`role_only`) or nothing known (`unrecognised`). part_ids are sorted; outcome is `gene`,
    `variant`, `source` or one of these.
    """
    said = entries.where("entry IS NOT NULL").select("config_id", "entry").distinct()
    key = ["entry"]  # what an entry names doesn't depend on who says it, so each text is read once
    e = said.select(*key).distinct().select(*key, tokens("entry").alias("tokens"), designations("entry").alias("named"))
    alias = F.create_map(*(F.lit(x.lower()) for pair in aliases.items() for x in pair)) if aliases else None
    by_gene = parts.select(F.explode(F.transform("genes", F.lower)).alias("gene"), "part_id", F.col("step_role").alias("role"), F.transform("designations", F.lower).alias("variants")).distinct()
    token = e.select(*key, "named", F.explode("tokens").alias("token"))
    gene = F.coalesce(F.element_at(alias, F.col("token")), F.col("token")) if alias is not None else F.col("token")
    hits = token.withColumn("gene", F.lower(gene)).join(by_gene, "gene").select(*key, "named", "part_id", "role", "variants").distinct()
    has = F.arrays_overlap("variants", "named")
    by_role = hits.groupBy(*key, "role").agg(F.array_sort(F.collect_set("part_id")).alias("every"), F.array_sort(F.collect_set(F.when(has, F.col("part_id")))).alias("having"))
    narrowed = (F.size("every") > 1) & (F.size("having") > 0)
    refused = narrowed & (F.size("having") > 1)
    outcome = F.when(refused, "ambiguous_variant").when(narrowed, "variant").otherwise("gene")
    known = by_role.select(*key, outcome.alias("outcome"), "role", F.when(narrowed, F.col("having")).otherwise(F.col("every")).alias("part_ids"))
    rest = e.join(known.select(*key).distinct(), key, "left_anti")
    roles = F.array_distinct(F.array_compact(F.transform("tokens", lambda t: F.element_at(F.create_map(*(F.lit(x) for pair in role_tokens.items() for x in pair)), t))))
    family = F.arrays_overlap("tokens", F.array(*map(F.lit, family_tokens))) if family_tokens else F.lit(False)
    genus, species = organism("entry")
    rest = rest.withColumns({"roles": roles, "family": family, "genus": genus, "species": species})
    sole = F.when((F.size("roles") == 1) & ~F.col("family") & (F.col("genus") != ""), F.col("roles")[0])
    rest = rest.withColumn("role", sole)
    words = F.split(F.lower("organism"), " ")
    homes = parts.select(F.col("step_role").alias("role"), F.col("part_id").alias("candidate"), words[0].alias("own_genus"), words[1].alias("species"))
    same = (F.col("genus") == F.col("own_genus")) | ((F.length("genus") == 1) & F.col("own_genus").startswith(F.col("genus")))
    found = rest.join(homes, ["role", "species"], "left").groupBy(*key, "role").agg(F.array_sort(F.collect_set(F.when(same, F.col("candidate")))).alias("part_ids"), F.first("roles").alias("roles"), F.first("family").alias("family"))
    n = F.size("part_ids")
    outcome = F.when(n == 1, "source").when(n > 1, "ambiguous_source").when((F.size("roles") > 0) | F.col("family"), "role_only").otherwise("unrecognised")
    other = found.select(*key, outcome.alias("outcome"), F.when(n > 0, F.col("role")).alias("role"), F.when(n > 0, F.col("part_ids")).alias("part_ids"))
    return said.join(known.unionByName(other), key).select("config_id", "entry", "outcome", "role", "part_ids")


def matching_routes(wanted: DataFrame, routes: DataFrame) -> DataFrame:
    """(signature, n_routes): routes of a strategy that have, at every role of a wish, one of its parts.

    wanted are (signature, strategy, role, part_id), routes (route_id, strategy, role, part_id) with one part a role.
    Routes of a strategy with the same parts are one class, counted. Set containment by inverted lists: a wish meets only
    the classes of its rarest role, and these are checked against the other roles. Wishes that are alike should come once.
    """
    own = routes.groupBy("strategy", "route_id").agg(F.array_sort(F.collect_list(F.struct("role", "part_id"))).alias("_parts"))
    posts = own.groupBy("strategy", "_parts").agg(F.count("*").alias("_many")).select("strategy", "_parts", "_many", F.inline("_parts"))
    lists = posts.groupBy("strategy", "role", "part_id").agg(F.sum("_many").alias("n"))
    sized = wanted.join(lists, ["strategy", "role", "part_id"], "left").groupBy("signature", "strategy", "role").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.collect_list(F.struct("role", "part_id")).alias("_any"))
    rarest = sized.groupBy("signature").agg(F.min(F.struct("n", "role"))["role"].alias("role"), F.count("*").alias("roles"), F.flatten(F.collect_list("_any")).alias("_wish"))
    first = wanted.join(rarest, ["signature", "role"]).join(posts, ["strategy", "role", "part_id"])
    whole = first.where(F.size(F.array_intersect("_wish", "_parts")) == F.col("roles"))
    return whole.groupBy("signature").agg(F.sum("_many").alias("n_routes"))


def classify(configs: DataFrame, entries: DataFrame, parts: DataFrame, routes: DataFrame, roles: Sequence[int], strategies: Sequence[str], chassis: str | None, aliases: Mapping[str, str], role_tokens: Mapping[str, int], family_tokens: Sequence[str] = ()) -> DataFrame:
    """(config_id, clause, n_routes, unfilled, ambiguous, partial) of every configuration; the first clause that fits.

    configs are (config_id, strategy, host, host_organism). A configuration matches if every role is filled and a route
    agrees at all of them. Named enzymes that no part carries are a catalogue gap; else a refusal at an unfilled role
    is named; else too little was said. `partial` are matches, and under-specified ones that a route agrees with at
    what they say. Configurations that ask for the same parts are matched once.
    """
    resolved = resolve_roles(entries, parts, aliases, role_tokens, family_tokens)
    fill = F.when(F.col("outcome").isin("gene", "variant", "source") & F.col("role").isin(*roles), F.struct("role", "part_ids"))
    at = lambda r: F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter("fills", lambda x: x["role"] == r), lambda x: x["part_ids"]))))
    by_role = F.filter(F.array(*(F.struct(F.lit(r).alias("role"), at(r).alias("part_ids")) for r in sorted(roles))), lambda x: F.size(x["part_ids"]) > 0)
    refusal = lambda name: F.array_sort(F.collect_set(F.when(F.col("outcome") == name, F.col("role")))).alias(name)
    said = resolved.groupBy("config_id").agg(refusal("ambiguous_source"), refusal("ambiguous_variant"), F.count_if(F.col("outcome") == "unrecognised").alias("unrecognised"), F.lit(True).alias("has_entries"), F.collect_set(fill).alias("fills"))
    said = said.withColumn("filled", F.when(F.size("fills") > 0, by_role)).drop("fills")
    c = configs.join(said, "config_id", "left")
    enumerable = F.coalesce(F.col("strategy").isin(*strategies), F.lit(False))
    abroad = F.lit(False) if chassis is None else ~F.col("host_organism").eqNullSafe(F.lit(chassis))
    c = c.withColumn("early", F.when(~enumerable, CLAUSES[0]).when(F.col("host").isNull(), CLAUSES[1]).when(abroad, CLAUSES[2]).when(F.col("has_entries").isNull(), CLAUSES[3]))
    wish = F.when(F.col("early").isNull() & F.col("filled").isNotNull(), F.to_json(F.struct("strategy", "filled")))
    c = c.withColumn("signature", wish)
    wanted = c.where("signature IS NOT NULL").groupBy("signature", "strategy").agg(F.first("filled").alias("filled"))
    wanted = wanted.select("signature", "strategy", F.inline("filled")).select("signature", "strategy", "role", F.explode("part_ids").alias("part_id"))
    c = c.join(matching_routes(wanted, routes), "signature", "left").na.fill(0, ["n_routes", "unrecognised"])
    none = F.array().cast("array<int>")
    have = F.transform(F.coalesce("filled", F.expr("CAST(array() AS array<struct<role: int, part_ids: array<bigint>>>)")), lambda x: x["role"].cast("int"))
    c = c.withColumn("unfilled", F.array_except(F.array(*(F.lit(r) for r in roles)), have))
    blocks = lambda name: F.arrays_overlap(F.coalesce(F.transform(name, lambda x: x.cast("int")), none), F.col("unfilled"))
    several = F.transform(F.filter(F.coalesce("filled", F.expr("CAST(array() AS array<struct<role: int, part_ids: array<bigint>>>)")), lambda x: F.size(x["part_ids"]) > 1), lambda x: x["role"].cast("int"))
    clause = F.when(F.col("early").isNotNull(), F.col("early")).when((F.size("unfilled") == 0) & (F.col("n_routes") > 0), CLAUSES[4]).when(F.col("unrecognised") > 0, CLAUSES[5])
    clause = clause.when(blocks("ambiguous_source"), CLAUSES[6]).when(blocks("ambiguous_variant"), CLAUSES[7]).otherwise(CLAUSES[8])
    late = F.col("early").isNull()
    c = c.withColumn("clause", clause)
    partial = (F.col("clause") == "matched") | ((F.col("clause") == "under_specified") & (F.col("n_routes") > 0))
    return c.select("config_id", "clause", "n_routes", F.when(late, F.col("unfilled")).alias("unfilled"), F.when(late, several).alias("ambiguous"), partial.alias("partial"))
