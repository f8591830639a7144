"""Derived evidence levels, comparability, bounds, verdicts and plans: derived values are computed, never stored."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as X

DIRECT = ("direct_perturbation", "direct_biochemical")
ASSOCIATION = ("correlative_omics", "comparative_genomic")
WEAK = ("literature_assertion", "ai_inference")


COUNTS = ("n_evidence", "n_direct", "n_direct_groups", "n_direct_directions", "n_assoc_pubs", "n_assoc_directions", "n_model", "n_weak")


def evidence_levels(assertions: DataFrame, evidence: DataFrame) -> DataFrame:
    """(assertion_id, the COUNTS, derived_level, is_overridden, level, derived_reason) of every assertion, also of those
    without evidence.

    One aggregate over active evidence; rules in order, the first that fits decides; an override shows on top. Only
    groups and publications are counted as distinct values; directions are few, and their set is kept instead.
    """
    kind = F.col("evidence_type")
    of = lambda kinds, c: F.when(kind.isin(*kinds), F.col(c))
    sums = evidence.where("status = 'active'").groupBy("assertion_id").agg(
        F.count("*").alias("n_evidence"),
        F.count(of(DIRECT, "evidence_id")).alias("n_direct"),
        F.count_distinct(of(DIRECT, "independent_group")).alias("n_direct_groups"),
        F.size(F.collect_set(of(DIRECT, "direction"))).cast("long").alias("n_direct_directions"),
        F.count_distinct(of(ASSOCIATION, "publication_id")).alias("n_assoc_pubs"),
        F.size(F.collect_set(of(ASSOCIATION, "direction"))).cast("long").alias("n_assoc_directions"),
        F.count(of(("computational_model",), "evidence_id")).alias("n_model"),
        F.count(of(WEAK, "evidence_id")).alias("n_weak"),
    )
    s = assertions.join(sums, "assertion_id", "left").na.fill(0, list(COUNTS))
    direct = F.col("n_direct") > 0
    rules: list[tuple[Column, str | None, str]] = [
        (F.col("n_evidence") == 0, None, "no_evidence"),
        (direct & F.col("open_conflict"), None, "direct_evidence_discordant"),
        (direct & (F.col("n_direct_groups") >= 2) & (F.col("n_direct_directions") <= 1), "L2", "direct_evidence_replicated"),
        (direct, "L1", "direct_evidence"),
        ((F.col("n_assoc_pubs") >= 3) & (F.col("n_assoc_directions") <= 1), "L3", "concordant_association"),
        ((F.col("n_model") > 0) & (F.col("n_assoc_pubs") == 0) & (F.col("n_weak") == 0), "L4", "computational_only"),
        (F.lit(True), "L5", "hypothesis_or_insufficient_support"),
    ]
    level, reason = F.lit(None).cast("string"), F.lit(None).cast("string")
    for test, name, why in reversed(rules):
        level, reason = F.when(test, F.lit(name)).otherwise(level), F.when(test, why).otherwise(reason)
    s = s.withColumns({"derived_level": level, "derived_reason": reason})
    return s.select("assertion_id", *COUNTS, "derived_level", F.col("level_override").isNotNull().alias("is_overridden"), F.coalesce("level_override", "derived_level").alias("level"), "derived_reason")


# ---------------------------------------------------------------- comparability


def known(facet: str) -> Column:
    """Whether a facet states a value: NULL, NA and unknown don't."""
    return F.col(facet).isNotNull() & ~F.coalesce(F.col(facet).cast("string"), F.lit("NA")).isin("unknown", "NA")


def comparability_class(required: Sequence[str], optional: Sequence[str] = ()) -> tuple[Column, Column]:
    """(class key, standing). The key names every facet, with `?` where it states nothing.

    One required facet that states nothing leaves the row unclassified, under a key of its own kind; an optional one
    makes the class provisional.
    """
    shown = [F.concat(F.lit(f"{f}="), F.when(known(f), F.col(f).cast("string")).otherwise("?")) for f in (*required, *optional)]
    blocked, blind = F.lit(False), F.lit(False)
    for f in required:
        blocked = blocked | ~known(f)
    for f in optional:
        blind = blind | ~known(f)
    key = F.concat_ws("|", F.when(blocked, "unclassified"), *shown)
    return key, F.when(blocked, "unclassified").when(blind, "provisional").otherwise("classified")


def rankable(rows: DataFrame, key: str, standing: str, unit: str, controlled: Column) -> DataFrame:
    """(key, n, rankable): a class ranks if it is classified, has more than one row, one unit and only controlled kinds."""
    ok = F.bool_and(F.col(standing) == "classified") & (F.min(unit) == F.max(unit)) & (F.count(unit) == F.count("*")) & (F.count("*") > 1) & F.bool_and(controlled)
    return rows.groupBy(key).agg(F.count("*").alias("n"), ok.alias("rankable"))


def facet_differences(subjects: DataFrame, by: str, equal: Sequence[str], bands: Mapping[str, tuple[float, str]]) -> DataFrame:
    """(by, facet, differs, within_tolerance) of the subjects of each comparison.

    Facets of `equal` differ if they show two values, stating nothing being one; those of `bands` (width, absolute or
    relative) if their range is wider than the band.
    """
    aggs = []
    for f in equal:
        shown = F.when(known(f), F.col(f).cast("string")).otherwise("?")
        aggs.append(F.struct(F.lit(f).alias("facet"), (F.min(shown) != F.max(shown)).alias("differs"), F.lit(False).alias("within_tolerance")))
    for f, (width, how) in bands.items():
        low, high = F.min(f), F.max(f)
        room = F.lit(width) * F.greatest(F.abs(low), F.abs(high)) if how == "relative" else F.lit(width)
        gap = (F.count(f) > 0) & (F.count(f) < F.count("*"))
        differs = F.coalesce(low != high, F.lit(False)) | gap
        aggs.append(F.struct(F.lit(f).alias("facet"), differs.alias("differs"), (differs & ~gap & (high - low <= room)).alias("within_tolerance")))
    return subjects.groupBy(by).agg(F.array(*aggs).alias("f")).select(by, F.inline("f"))


def compare(subjects: DataFrame, by: str, subject: str, key: str, standing: str, differences: DataFrame, most: int) -> DataFrame:
    """(by, verdict) of comparisons: refuse with fewer than two or more than `most` subjects, or if none is classified;
    warn if classes or facets differ, a class is provisional or a subject has none; else comparable."""
    has = F.col(standing).isin("classified", "provisional")
    s = subjects.groupBy(by).agg(
        F.count_distinct(subject).alias("_n"), F.count_if(has).alias("_classed"), F.count_if(F.col(standing) == "provisional").alias("_provisional"),
        F.count("*").alias("_rows"), (F.min(F.when(has, F.col(key))) != F.max(F.when(has, F.col(key)))).alias("_apart"),
    )
    d = differences.groupBy(by).agg(F.bool_or(F.col("differs") & ~F.col("within_tolerance")).alias("_differs"))
    j = s.join(d, by, "left")
    refuse = (F.col("_n") < 2) | (F.col("_n") > most) | (F.col("_classed") == 0)
    warn = F.col("_apart") | F.coalesce("_differs", F.lit(False)) | (F.col("_provisional") > 0) | (F.col("_classed") < F.col("_rows"))
    return j.select(by, F.when(refuse, "refuse").when(warn, "warn").otherwise("comparable").alias("verdict"))


# ---------------------------------------------------------------- bounds and steps

#: Slack of the bound, units of a mass ratio, bases that are fractions of the maximum.
EPSILON, MASS_UNITS, FRACTIONS = 1e-9, ("g/g", "mg/mg", "kg/kg"), ("fraction_of_theoretical", "percent_of_theoretical_as_fraction")


def bound_check(rows: DataFrame, ceilings: DataFrame, row: str, fractions: Sequence[str] = FRACTIONS, units: Sequence[str] = MASS_UNITS) -> DataFrame:
    """(row, verdict, ceiling) of measurements (row, kind, value, unit, basis, product, substrates) against ceilings
    (product, substrate, g_per_g, usable).

    A yield without a basis is refused; a fraction of the maximum has the ceiling 1; other kinds, units and rows without
    a product aren't evaluable. A mixture is evaluable only if each of its substrates has one usable ceiling and all are
    the same. Above the ceiling, by more than EPSILON, a row is flagged.
    """
    low, high = F.min("g_per_g").alias("low"), F.max("g_per_g").alias("high")
    every = F.bool_and(F.coalesce("usable", F.lit(False)) & F.col("g_per_g").isNotNull()).alias("all")
    # a product's ceilings are one row beside it, so a measurement is joined once and never grouped
    c = ceilings.groupBy("product", "substrate").agg(every, low, high).groupBy("product").agg(F.collect_list(F.struct("substrate", "all", "low", "high")).alias("_ceilings"))
    mine = F.filter("_ceilings", lambda x: F.array_contains("substrates", x["substrate"]))
    low, high = F.array_min(F.transform("_mine", lambda x: x["low"])), F.array_max(F.transform("_mine", lambda x: x["high"]))
    usable = (F.size("_mine") > 0) & (F.size("_mine") == F.size(F.array_distinct("substrates"))) & F.forall("_mine", lambda x: x["all"]) & (low == high)
    j = rows.join(c, "product", "left").withColumn("_mine", mine).withColumn("_max", F.when(usable, low))
    fraction, value = F.coalesce(F.col("basis").isin(*fractions), F.lit(False)), F.col("value")
    verdict = (
        F.when((F.col("kind") == "yield") & F.col("basis").isNull(), "refused")
        .when(fraction, F.when((value > 1 + EPSILON) | (value < 0), "flag").otherwise("pass"))
        .when((F.col("kind") != "yield") | ~F.lower(F.coalesce("unit", F.lit(""))).isin(*units) | F.col("product").isNull() | F.col("_max").isNull(), "not_evaluable")
        .when(value > F.col("_max") * (1 + EPSILON), "flag").otherwise("pass")
    )
    return j.select(row, verdict.alias("verdict"), F.when(fraction, 1.0).when(verdict.isin("flag", "pass"), F.col("_max")).alias("ceiling"))


def step_verdicts(observations: DataFrame, step: str, contrast: str, lfc: str, p: str, confounded: Column, most_p: float = 0.05, least_lfc: float = 1.0) -> DataFrame:
    """(step, verdict, lfc, contrast, agreeing, contrasts) over all contrasts that observe a step.

    Passing contrasts must agree: up and down at once is inconsistent. Without one that passes, the largest change says
    whether the step is unresolved or unchanged. A step whose reads the construct may own is confounded.
    """
    passes = F.col(p).isNotNull() & (F.col(p) <= most_p) & (F.abs(F.col(lfc)) >= least_lfc)
    up, down = passes & (F.col(lfc) > 0), passes & (F.col(lfc) < 0)
    size = F.struct(F.abs(F.col(lfc)).alias("size"), F.col(contrast).alias("contrast"), F.col(lfc).alias("lfc"))
    s = observations.withColumn("_confounded", confounded).where(F.col(lfc).isNotNull() | F.col("_confounded")).groupBy(step).agg(
        F.bool_or("_confounded").alias("_confounded"), F.bool_or(up).alias("_up"), F.bool_or(down).alias("_down"), F.max(F.when(passes, size)).alias("_win"),
        F.max(F.when(F.col(lfc).isNotNull(), size)).alias("_top"), F.count_distinct(F.when(passes, F.col(contrast))).alias("_agree"), F.count_distinct(F.when(F.col(lfc).isNotNull(), F.col(contrast))).alias("contrasts"),
    )
    j = observations.select(step).distinct().join(s, step, "left")
    both = F.col("_up") & F.col("_down")
    shown = F.when(F.col("_confounded") | both, None).otherwise(F.coalesce("_win", "_top"))
    verdict = (
        F.when(F.col("_confounded"), "confounded_by_construct").when(F.col("_top").isNull(), "no_contrast").when(both, "inconsistent_across_contrasts")
        .when(F.col("_up"), "elevated_in_build").when(F.col("_down"), "reduced_in_build").when(F.col("_top.size") >= least_lfc, "elevated_not_resolved").otherwise("unchanged_in_build")
    )
    return j.select(step, verdict.alias("verdict"), shown["lfc"].alias("lfc"), shown["contrast"].alias("contrast"), F.when(both, 0).otherwise(F.coalesce("_agree", F.lit(0))).alias("agreeing"), F.coalesce("contrasts", F.lit(0)).alias("contrasts"))


# ---------------------------------------------------------------- plans


def plan(rows: DataFrame, requirements: Mapping[str, Column], keys: Sequence[str], fatal: Sequence[str] | None = None) -> DataFrame:
    """(keys, blockers, ready): the requirements that a row doesn't meet, by name, in order; unknown counts as unmet.

    `fatal` names those that keep a row from being ready; without it all do.
    """
    unmet = {k: ~F.coalesce(c, F.lit(False)) for k, c in requirements.items()}
    blockers = F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in unmet.items())))
    stop = F.lit(False)
    for k in requirements if fatal is None else fatal:
        stop = stop | unmet[k]
    return rows.select(*keys, blockers.alias("blockers"), (~stop).alias("ready"))


def references(rows: DataFrame, keys: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """rows with has_<column> for each foreign key: whether the row that it names exists."""
    out = rows
    for column, (table, key) in keys.items():
        there = table.select(F.col(key).alias(column), F.lit(True).alias(f"has_{column}")).distinct()
        out = out.join(there, column, "left").withColumn(f"has_{column}", F.coalesce(f"has_{column}", F.lit(False)))
    return out


def drafts(rows: DataFrame, kind: str, subject: Column, predicate: str, object_: Column, number: Column, evidence_type: str, group: str, direction: Column) -> DataFrame:
    """Draft statements (statement_id, source_kind, subject, predicate, object, statement, evidence_type,
    independent_group, direction) from rows of one kind: a measurement, a modification or a bottleneck.

    The id is a digest of what is stated, so the same draft has the same id each time; a row whose subject or object is
    unknown gives no draft.
    """
    said = F.concat_ws(" ", subject, F.lit(predicate), object_, number)
    out = rows.select(
        F.lit(kind).alias("source_kind"), subject.alias("subject"), F.lit(predicate).alias("predicate"), object_.alias("object"), said.alias("statement"),
        F.lit(evidence_type).alias("evidence_type"), F.col(group).cast("string").alias("independent_group"), direction.alias("direction"),
    ).where("subject IS NOT NULL AND object IS NOT NULL")
    return out.withColumn("statement_id", F.substring(F.sha2(F.concat_ws("|", "source_kind", "statement", "evidence_type", "independent_group", "direction"), 256), 1, 16))


def corroborate(quote: Column, fields: Mapping[str, tuple[str, Column]]) -> Column:
    """(verdict, absent): whether a record's own quote names every identifying field {name: (kind, value)}.

    A number counts in any of its spellings, a unit in any of its, a name of three characters or more if it stands in the
    quote, names one thing, and tells it from others. All found accepts; anything missing goes to a reader.
    """
    hay = X.nfkc(quote)
    missing = []
    for name, (kind, value) in fields.items():
        if kind == "number":
            found = X.names_number(hay, value)
        elif kind == "unit":
            found = X.names_unit(hay, value)
        else:
            folded = X.nfkc(value)
            found = X.names_one_thing(value) & X.distinguishing(value) & (F.length(folded) >= 3) & F.contains(hay, folded)
        stated = value.isNotNull() & (F.trim(value.cast("string")) != "")
        missing.append(F.when(~F.coalesce(stated & found, F.lit(False)), F.lit(name)))
    absent = F.array_compact(F.array(*missing))
    blank = F.coalesce(F.trim(quote) == "", F.lit(True))
    return F.struct(F.when(~blank & (F.size(absent) == 0), "accept").otherwise("review").alias("verdict"), absent.alias("absent"))


def redundant(runs: DataFrame, unit: str) -> DataFrame:
    """runs with `members`, each that isn't the only one of its unit: rows of one unit are no independent observations.

    Units are counted in each task first and joined back, so a unit with very many runs is no one task's. Null units don't count.
    """
    sizes = runs.where(F.col(unit).isNotNull()).groupBy(unit).agg(F.count("*").alias("members")).where("members > 1")
    return runs.join(sizes, unit)
