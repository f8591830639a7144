"""Evidence, comparability and quality decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as X
from quillon.operators import evidence as E
from quillon.operators import relational as R
from quillon.registry import query
from quillon.sources.standins import Tables

_LEVELS = """
    s AS (SELECT a.assertion_id, a.level_override, a.open_conflict, count(e.evidence_id) AS n,
      count(e.evidence_id) FILTER (e.evidence_type IN ('direct_perturbation', 'direct_biochemical')) AS direct,
      count(DISTINCT e.independent_group) FILTER (e.evidence_type IN ('direct_perturbation', 'direct_biochemical')) AS grps,
      count(DISTINCT e.direction) FILTER (e.evidence_type IN ('direct_perturbation', 'direct_biochemical')) AS dirs,
      count(DISTINCT e.publication_id) FILTER (e.evidence_type IN ('correlative_omics', 'comparative_genomic')) AS pubs,
      count(DISTINCT e.direction) FILTER (e.evidence_type IN ('correlative_omics', 'comparative_genomic')) AS adirs,
      count(e.evidence_id) FILTER (e.evidence_type = 'computational_model') AS models, count(e.evidence_id) FILTER (e.evidence_type IN ('literature_assertion', 'ai_inference')) AS weak
      FROM v_assertion a LEFT JOIN v_evidence_item e ON e.assertion_id = a.assertion_id AND e.status = 'active' GROUP BY ALL),
    l AS (SELECT *, CASE WHEN n = 0 THEN 'no_evidence' WHEN direct > 0 AND open_conflict THEN 'direct_evidence_discordant' WHEN grps >= 2 AND dirs <= 1 THEN 'direct_evidence_replicated' WHEN direct > 0 THEN 'direct_evidence'
      WHEN pubs >= 3 AND adirs <= 1 THEN 'concordant_association' WHEN models > 0 AND pubs = 0 AND weak = 0 THEN 'computational_only' ELSE 'hypothesis_or_insufficient_support' END AS reason FROM s),
    g AS (SELECT *, CASE reason WHEN 'direct_evidence_replicated' THEN 'L2' WHEN 'direct_evidence' THEN 'L1' WHEN 'concordant_association' THEN 'L3' WHEN 'computational_only' THEN 'L4' WHEN 'hypothesis_or_insufficient_support' THEN 'L5' END AS derived_level FROM l)"""


@query("evidence_level", f"WITH {_LEVELS} SELECT assertion_id, n AS n_evidence, direct AS n_direct, grps AS n_direct_groups, dirs AS n_direct_directions, pubs AS n_assoc_pubs, adirs AS n_assoc_directions, models AS n_model, weak AS n_weak, derived_level, level_override IS NOT NULL AS is_overridden, coalesce(level_override, derived_level) AS level, reason AS derived_reason FROM g")
def evidence_level(t: Tables) -> DataFrame:
    return E.evidence_levels(t.v_assertion, t.v_evidence_item)


@query("conflicted", f"WITH {_LEVELS} SELECT assertion_id, reason FROM g WHERE coalesce(level_override, derived_level) IS NULL")
def conflicted(t: Tables) -> DataFrame:
    return evidence_level(t).where("level IS NULL").select("assertion_id", F.col("derived_reason").alias("reason"))


@query("absences", "SELECT 'unlabelled' AS kind, count(*) FILTER (quality IS NULL) AS n FROM v_document UNION ALL SELECT 'no_sample', count(*) FILTER (sample_id IS NULL) FROM v_measurement UNION ALL SELECT 'unknown_aeration', count(*) FILTER (aeration = 'unknown') FROM v_context")
def absences(t: Tables) -> DataFrame:
    one = lambda k, df, c: df.agg(F.lit(k).alias("kind"), F.count_if(c).alias("n"))
    return one("unlabelled", t.v_document, F.col("quality").isNull()).union(one("no_sample", t.v_measurement, F.col("sample_id").isNull())).union(one("unknown_aeration", t.v_context, F.col("aeration") == "unknown"))


_CLASS = "CASE WHEN aeration = 'unknown' THEN 'unclassified|aeration=?' ELSE 'aeration=' || aeration END || '|feedstock=' || feedstock || '|carbon_regime=' || coalesce(carbon_regime, '?')"
_STANDING = "CASE WHEN aeration = 'unknown' THEN 'unclassified' WHEN carbon_regime IS NULL THEN 'provisional' ELSE 'classified' END"


@query("comparability_class", f"SELECT context_id, {_CLASS} AS class_key, {_STANDING} AS standing FROM v_context")
def comparability_class(t: Tables) -> DataFrame:
    key, standing = E.comparability_class(["aeration", "feedstock"], ["carbon_regime"])
    return t.v_context.select("context_id", key.alias("class_key"), standing.alias("standing"))


@query(
    "facet_differences",
    """WITH c AS (SELECT *, feedstock || '/' || context_id % 40 AS k FROM v_context)
    SELECT k, 'aeration' AS facet, count(DISTINCT aeration) > 1 AS differs, false AS within_tolerance FROM c GROUP BY k
    UNION ALL SELECT k, 'carbon_regime', count(DISTINCT coalesce(carbon_regime, '?')) > 1, false FROM c GROUP BY k
    UNION ALL SELECT k, 'temperature_c', max(temperature_c) > min(temperature_c), max(temperature_c) > min(temperature_c) AND max(temperature_c) - min(temperature_c) <= 2 FROM c GROUP BY k
    UNION ALL SELECT k, 'sugar', max(sugar) > min(sugar), max(sugar) > min(sugar) AND max(sugar) - min(sugar) <= 0.25 * greatest(abs(max(sugar)), abs(min(sugar))) FROM c GROUP BY k""",
)
def facet_differences(t: Tables) -> DataFrame:
    c = t.v_context.withColumn("k", F.concat_ws("/", "feedstock", (F.col("context_id") % 40).cast("string")))
    return E.facet_differences(c, "k", ["aeration", "carbon_regime"], {"temperature_c": (2.0, "absolute"), "sugar": (0.25, "relative")})


@query(
    "compare_verdict",
    f"""WITH c AS (SELECT *, feedstock || '/' || context_id % 40 AS k, {_CLASS} AS class_key, {_STANDING} AS standing FROM v_context),
    g AS (SELECT k, count(*) AS n, count(*) FILTER (standing <> 'unclassified') AS classed, count(*) FILTER (standing = 'provisional') AS prov, count(DISTINCT class_key) FILTER (standing <> 'unclassified') AS keys,
      max(temperature_c) - min(temperature_c) > 2 OR max(sugar) - min(sugar) > 0.25 * greatest(abs(max(sugar)), abs(min(sugar))) OR count(DISTINCT aeration) > 1 AS differs FROM c GROUP BY k)
    SELECT k, CASE WHEN n < 2 OR n > 6 OR classed = 0 THEN 'refuse' WHEN keys > 1 OR differs OR prov > 0 OR classed < n THEN 'warn' ELSE 'comparable' END AS verdict FROM g""",
)
def compare_verdict(t: Tables) -> DataFrame:
    key, standing = E.comparability_class(["aeration", "feedstock"], ["carbon_regime"])
    c = t.v_context.withColumn("k", F.concat_ws("/", "feedstock", (F.col("context_id") % 40).cast("string"))).withColumns({"class_key": key, "standing": standing})
    differences = E.facet_differences(c, "k", ["aeration"], {"temperature_c": (2.0, "absolute"), "sugar": (0.25, "relative")})
    return E.compare(c, "k", "context_id", "class_key", "standing", differences, 6)


@query("compare_candidates", "SELECT strain_id, count(*) AS n FROM v_measurement GROUP BY strain_id ORDER BY n DESC, strain_id LIMIT 20")
def compare_candidates(t: Tables) -> DataFrame:
    return t.v_measurement.groupBy("strain_id").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "strain_id").limit(20)


@query(
    "rankable_classes",
    f"""WITH c AS (SELECT m.*, {_CLASS} AS class_key, {_STANDING} AS standing FROM v_measurement m JOIN v_context c ON c.context_id = m.product_id)
    SELECT class_key, count(*) AS n, bool_and(standing = 'classified') AND count(DISTINCT unit) = 1 AND count(*) > 1 AND bool_and(quantity_kind IN ('A', 'N')) AS rankable FROM c GROUP BY class_key""",
)
def rankable_classes(t: Tables) -> DataFrame:
    key, standing = E.comparability_class(["aeration", "feedstock"], ["carbon_regime"])
    c = t.v_measurement.join(t.v_context.select("context_id", key.alias("class_key"), standing.alias("standing")), F.col("product_id") == F.col("context_id"))
    return E.rankable(c, "class_key", "standing", "unit", F.col("quantity_kind").isin("A", "N"))


@query("row_warnings", "SELECT measurement_id, product_id, concat_ws(',', CASE WHEN sample_id IS NULL THEN 'no_sample' END, CASE WHEN value > 45 THEN 'high' END, CASE WHEN discount = 0 THEN 'no_basis' END) AS warnings FROM v_measurement")
def row_warnings(t: Tables) -> DataFrame:
    w = F.array_compact(F.array(F.when(F.col("sample_id").isNull(), F.lit("no_sample")), F.when(F.col("value") > 45, F.lit("high")), F.when(F.col("discount") == 0, F.lit("no_basis"))))
    return t.v_measurement.select("measurement_id", "product_id", F.array_join(w, ",").alias("warnings"))


@query(
    "bound_check",
    """WITH m AS (SELECT measurement_id * 1000000 + product_id AS id, value / 50 AS value, CASE quantity_kind WHEN 'A' THEN 'titer' ELSE 'yield' END AS kind, CASE unit WHEN 'F' THEN 'g/g' ELSE 'unknown' END AS unit,
      CASE WHEN line = 7 THEN NULL WHEN line = 6 THEN 'fraction_of_theoretical' ELSE 'consumed' END AS basis, CASE WHEN line <> 5 THEN product_id END AS product,
      CASE line % 4 WHEN 0 THEN ['glucose'] WHEN 1 THEN ['glucose', 'xylose'] WHEN 2 THEN ['glucose', 'galactose'] ELSE [] END AS subs FROM v_measurement),
    c AS (SELECT *, CASE WHEN len(subs) = 0 OR p.carbons <= 3 THEN NULL WHEN list_contains(subs, 'galactose') THEN NULL ELSE 0.41 END AS top FROM m LEFT JOIN v_product p ON p.product_id = m.product)
    SELECT id, CASE WHEN kind = 'yield' AND basis IS NULL THEN 'refused' WHEN basis = 'fraction_of_theoretical' THEN CASE WHEN value > 1 + 1e-9 OR value < 0 THEN 'flag' ELSE 'pass' END
      WHEN kind <> 'yield' OR unit <> 'g/g' OR product IS NULL OR top IS NULL THEN 'not_evaluable' WHEN value > top * (1 + 1e-9) THEN 'flag' ELSE 'pass' END AS verdict FROM c""",
)
def bound_check(t: Tables) -> DataFrame:
    line = F.col("line")
    few = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    rows = t.v_measurement.select(
        (F.col("measurement_id") * 1000000 + F.col("product_id")).alias("id"), (F.col("value") / 50).alias("value"), F.when(F.col("quantity_kind") == "A", "titer").otherwise("yield").alias("kind"),
        F.when(F.col("unit") == "F", "g/g").otherwise("unknown").alias("unit"), F.when(line == 7, None).when(line == 6, "fraction_of_theoretical").otherwise("consumed").alias("basis"), F.when(line != 5, F.col("product_id")).alias("product"),
        F.when(line % 4 == 0, few("glucose")).when(line % 4 == 1, few("glucose", "xylose")).when(line % 4 == 2, few("glucose", "galactose")).otherwise(few()).alias("substrates"),
    )
    one = lambda s, g: t.v_product.where("carbons > 3").select(F.col("product_id").alias("product"), F.lit(s).alias("substrate"), F.lit(g).alias("g_per_g"), F.lit(True).alias("usable"))
    return E.bound_check(rows, one("glucose", 0.41).union(one("xylose", 0.41)).union(one("galactose", 0.39)), "id").select("id", "verdict")


@query(
    "step_verdict",
    """WITH o AS (SELECT product_id, strain_id AS contrast, (value - 25) / 12 AS lfc, CASE WHEN line <> 7 THEN tax END AS p FROM v_measurement),
    g AS (SELECT product_id, max(abs(lfc)) AS top, max(abs(lfc)) FILTER (p <= 0.02 AND abs(lfc) >= 1) AS win, bool_or(p <= 0.02 AND lfc >= 1) AS up, bool_or(p <= 0.02 AND lfc <= -1) AS down,
      count(DISTINCT contrast) AS contrasts, count(DISTINCT contrast) FILTER (p <= 0.02 AND abs(lfc) >= 1) AS agree FROM o GROUP BY product_id)
    SELECT product_id, CASE WHEN product_id % 29 = 0 THEN 'confounded_by_construct' WHEN coalesce(up, false) AND coalesce(down, false) THEN 'inconsistent_across_contrasts' WHEN up THEN 'elevated_in_build' WHEN down THEN 'reduced_in_build' WHEN top >= 1 THEN 'elevated_not_resolved' ELSE 'unchanged_in_build' END AS verdict,
      CASE WHEN product_id % 29 = 0 OR coalesce(up, false) AND coalesce(down, false) THEN NULL ELSE round(coalesce(win, top), 6) END AS strongest, CASE WHEN coalesce(up, false) AND coalesce(down, false) THEN 0 ELSE agree END AS agreeing, contrasts FROM g""",
)
def step_verdict(t: Tables) -> DataFrame:
    o = t.v_measurement.select("product_id", F.col("strain_id").alias("contrast"), ((F.col("value") - 25) / 12).alias("lfc"), F.when(F.col("line") != 7, F.col("tax")).alias("p"))
    v = E.step_verdicts(o, "product_id", "contrast", "lfc", "p", F.col("product_id") % 29 == 0, most_p=0.02)
    return v.select("product_id", "verdict", F.round(F.abs("lfc"), 6).alias("strongest"), "agreeing", "contrasts")


@query("route_score", "SELECT reaction_id, CASE WHEN count(*) FILTER (role = 'product') > 0 THEN round(count(*) FILTER (role = 'product' AND coefficient > 20) / count(*) FILTER (role = 'product')::DOUBLE, 6) END AS score FROM v_participant GROUP BY reaction_id")
def route_score(t: Tables) -> DataFrame:
    product = F.col("role") == "product"
    score = F.try_divide(F.count_if(product & (F.col("coefficient") > 20)), F.count_if(product))
    return t.v_participant.groupBy("reaction_id").agg(F.round(score, 6).alias("score"))


_HEAD = """WITH q AS (SELECT target_id FROM v_flag WHERE status = 'active'), m AS (SELECT * FROM v_measurement WHERE strain_id NOT IN (SELECT target_id FROM q)),
    best AS (SELECT p.tier, m.product_id, m.strain_id, m.value, row_number() OVER (PARTITION BY p.tier ORDER BY m.value DESC, m.price DESC, m.measurement_id, m.product_id) AS rn, count(*) OVER (PARTITION BY p.tier) AS variants FROM m JOIN v_product p ON p.product_id = m.product_id),
    y AS (SELECT strain_id, max(value) AS best_yield, count(DISTINCT product_id) AS products FROM m GROUP BY strain_id)
    SELECT b.tier, b.product_id, b.value, b.variants, s.canonical_name, y.best_yield, y.products FROM best b JOIN v_strain s ON s.strain_id = b.strain_id LEFT JOIN y ON y.strain_id = b.strain_id WHERE b.rn = 1"""


@query("headline_answer", _HEAD)
def headline_answer(t: Tables) -> DataFrame:
    held = t.v_flag.where("status = 'active'").select(F.col("target_id").alias("strain_id"))
    m = t.v_measurement.join(held, "strain_id", "left_anti")
    ranked = m.join(t.v_product.select("product_id", "tier"), "product_id")
    # best and count in one aggregate: a tier with a third of all rows is summed before the shuffle
    best = F.max(F.struct("value", "price", (-F.col("measurement_id")).alias("neg"), (-F.col("product_id")).alias("negp"), "product_id", "strain_id"))
    b = ranked.groupBy("tier").agg(best.alias("b"), F.count("*").alias("variants")).select("tier", "variants", "b.product_id", "b.strain_id", "b.value")
    y = m.groupBy("strain_id").agg(F.max("value").alias("best_yield"), F.count_distinct("product_id").alias("products"))
    return b.join(t.v_strain, "strain_id").join(y, "strain_id", "left").select("tier", "product_id", "value", "variants", "canonical_name", "best_yield", "products")


@query("assert_distinct", "SELECT DISTINCT product_id, strain_id, quantity_kind FROM v_measurement WHERE value >= 45 AND tax <= 0.05")
def assert_distinct(t: Tables) -> DataFrame:
    return t.v_measurement.where("value >= 45 AND tax <= 0.05").select("product_id", "strain_id", "quantity_kind").dropDuplicates()


@query(
    "plan_blockers",
    "SELECT task_id, status, concat_ws(',', CASE WHEN status <> 'pending' THEN 'is_pending' END, CASE WHEN attempts >= 3 THEN 'not_stalled' END, CASE WHEN c.c_custkey IS NULL THEN 'has_extraction' END, CASE WHEN NOT coalesce(c.c_acctbal >= 0, false) THEN 'not_quarantined' END) AS blockers, status = 'pending' AND c.c_custkey IS NOT NULL AS ready FROM v_queue q LEFT JOIN customer c ON c.c_custkey = q.extraction_id AND c.c_custkey % 3 <> 0",
)
def plan_blockers(t: Tables) -> DataFrame:
    c = t.customer.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("extraction_id"), "c_acctbal")
    rows = E.references(t.v_queue, {"extraction_id": (c, "extraction_id")}).join(c, "extraction_id", "left")
    needs = {"is_pending": F.col("status") == "pending", "not_stalled": F.col("attempts") < 3, "has_extraction": F.col("has_extraction_id"), "not_quarantined": F.col("c_acctbal") >= 0}
    p = E.plan(rows, needs, ["task_id", "status"], fatal=["is_pending", "has_extraction"])
    return p.select("task_id", "status", F.array_join("blockers", ",").alias("blockers"), "ready")


@query(
    "draft_statements",
    """SELECT 'measurement' AS source_kind, 'strain ' || strain_id || ' produces product ' || product_id || ' ' || value AS statement, 'direct_biochemical' AS evidence_type, experiment_id::VARCHAR AS independent_group, CASE WHEN value > 25 THEN 'increases' ELSE 'decreases' END AS direction FROM v_measurement WHERE sample_id IS NOT NULL
    UNION ALL SELECT 'modification', 'strain ' || s_suppkey || ' carries gene ' || s_nationkey, 'direct_perturbation', s_nationkey::VARCHAR, NULL FROM supplier
    UNION ALL SELECT 'bottleneck', 'reaction ' || reaction_id || ' limits metabolite ' || metabolite_id, 'computational_model', line::VARCHAR, 'decreases' FROM v_participant WHERE role = 'substrate'""",
)
def draft_statements(t: Tables) -> DataFrame:
    named = lambda kind, c: F.concat_ws(" ", F.lit(kind), F.col(c).cast("string"))
    nothing = F.lit(None).cast("string")
    m = E.drafts(t.v_measurement, "measurement", F.when(F.col("sample_id").isNotNull(), named("strain", "strain_id")), "produces", named("product", "product_id"), F.col("value").cast("string"), "direct_biochemical", "experiment_id", F.when(F.col("value") > 25, "increases").otherwise("decreases"))
    s = E.drafts(t.supplier, "modification", named("strain", "s_suppkey"), "carries", named("gene", "s_nationkey"), nothing, "direct_perturbation", "s_nationkey", nothing)
    b = E.drafts(t.v_participant.where("role = 'substrate'"), "bottleneck", named("reaction", "reaction_id"), "limits", named("metabolite", "metabolite_id"), nothing, "computational_model", "line", F.lit("decreases"))
    return m.union(s).union(b).select("source_kind", "statement", "evidence_type", "independent_group", "direction")


@query(
    "validate_records",
    "SELECT measurement_id, product_id, concat_ws(',', CASE WHEN sample_id IS NULL THEN 'provenance' END, CASE WHEN value <= 0 THEN 'positive' END, CASE WHEN unit <> 'F' THEN 'unit' END, CASE WHEN product_id % 11 = 0 THEN 'entity' END, CASE WHEN line % 3 = 1 THEN 'span' END, CASE WHEN quantity_kind = 'R' AND discount = 0 THEN 'basis' END) AS issues, NOT (value <= 0 OR product_id % 11 = 0 OR line % 3 = 1 OR (quantity_kind = 'R' AND discount = 0)) AS accepted FROM v_measurement",
)
def validate_records(t: Tables) -> DataFrame:
    # the stand-in's source text holds the quote where it is said to stand, but for one line in three
    source, quote = F.lit("yield was 12 g/L in batch"), F.when(F.col("line") % 3 == 1, "yield was 21").otherwise("was 12")
    products = t.v_product.where("product_id % 11 <> 0")
    rows = E.references(t.v_measurement, {"product_id": (products, "product_id")})
    needs = {
        "provenance": F.col("sample_id").isNotNull(), "positive": F.col("value") > 0, "unit": R.in_values("unit", ["F"]), "entity": F.col("has_product_id"),
        "span": X.span_verdict(source, F.lit(6), quote) == "exact", "basis": (F.col("quantity_kind") != "R") | (F.col("discount") != 0),
    }
    p = E.plan(rows, needs, ["measurement_id", "product_id"], fatal=["positive", "entity", "span", "basis"])
    return p.select("measurement_id", "product_id", F.array_join("blockers", ",").alias("issues"), F.col("ready").alias("accepted"))


@query(
    "corroborate",
    "SELECT p_partkey, CASE WHEN p_size % 2 = 0 AND p_partkey % 3 <> 0 AND p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 THEN 'accept' ELSE 'review' END AS verdict, concat_ws(',', CASE WHEN p_partkey % 5 = 0 OR p_partkey % 7 = 0 THEN 'strain' END, CASE WHEN p_size % 2 <> 0 THEN 'value' END, CASE WHEN p_partkey % 3 = 0 THEN 'unit' END) AS absent FROM part",
)
def corroborate(t: Tables) -> DataFrame:
    k, text = F.col("p_partkey"), lambda c: F.col(c).cast("string")
    quote = F.concat(F.lit("Strain “YQ"), text("p_partkey"), F.lit("” and Strain B reached "), F.when(F.col("p_size") % 2 == 0, text("p_size")).otherwise("no more"), F.lit(" g L−1 of it."))
    strain = F.when(k % 5 == 0, F.concat(F.lit("YQ"), text("p_partkey"), F.lit(" and Strain B"))).when(k % 7 == 0, text("p_partkey")).otherwise(F.concat(F.lit("yq"), text("p_partkey")))
    value = F.when(F.col("p_size") % 2 == 0, F.concat(text("p_size"), F.lit(".0"))).otherwise(F.lit("12345.5"))
    c = E.corroborate(quote, {"strain": ("name", strain), "value": ("number", value), "unit": ("unit", F.when(k % 3 == 0, "mmol").otherwise("g/L"))})
    return t.part.select("p_partkey", c.alias("c")).select("p_partkey", "c.verdict", F.array_join("c.absent", ",").alias("absent"))


@query(
    "coverage_state",
    """SELECT entity, n, pending, CASE WHEN n > 0 THEN 'populated' WHEN pending > 0 THEN 'awaiting_curation' ELSE 'never_populated' END AS state FROM (
    SELECT 'documents' AS entity, (SELECT count(*) FROM documents) AS n, 0 AS pending UNION ALL SELECT 'flags', (SELECT count(*) FROM v_flag WHERE statistic > 0), (SELECT count(*) FROM v_queue WHERE status = 'pending') UNION ALL SELECT 'routes', 0, 0) x""",
)
def coverage_state(t: Tables) -> DataFrame:
    zero = lambda k: t._spark.createDataFrame([(k, 0)], "entity string, n long")
    counts = t.documents.agg(F.lit("documents").alias("entity"), F.count("*").alias("n")).union(t.v_flag.agg(F.lit("flags"), F.count_if(F.col("statistic") > 0))).union(zero("routes"))
    pending = t.v_queue.where("status = 'pending'").agg(F.lit("flags").alias("entity"), F.count("*").alias("pending"))
    j = counts.join(pending, "entity", "left").na.fill(0, ["pending"])
    return j.withColumn("state", F.when(F.col("n") > 0, "populated").when(F.col("pending") > 0, "awaiting_curation").otherwise("never_populated"))
