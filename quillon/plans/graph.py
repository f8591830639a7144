"""Routes, balances and provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators import graph as G
from quillon.operators import provenance as P
from quillon.operators import recall as R
from quillon.registry import query
from quillon.sources.standins import Tables


@query(
    "route_product",
    "SELECT a.part_id AS part_0, b.part_id AS part_1, c.part_id AS part_2, d.part_id AS part_3, e.part_id AS part_4 FROM v_route_part a, v_route_part b, v_route_part c, v_route_part d, v_route_part e WHERE a.step_role = 0 AND b.step_role = 1 AND c.step_role = 2 AND d.step_role = 3 AND e.step_role = 4",
)
def route_product(t: Tables) -> DataFrame:
    return G.route_product(t.v_route_part, [0, 1, 2, 3, 4], "part_id", "step_role")


@query(
    "power_set",
    """WITH i AS (SELECT list_sort(list(part_id)) AS a FROM v_route_part WHERE step_role = 5), m AS (SELECT a, unnest(range(0, 1 << len(a))) AS mask FROM i),
    s AS (SELECT list_filter(a, lambda x, i: (mask >> (i - 1)) & 1 = 1) AS s FROM m) SELECT array_to_string(s, ',') AS subset, len(s)::INT AS size FROM s""",
)
def power_set(t: Tables) -> DataFrame:
    out = G.power_set(t.v_route_part.where("step_role = 5"), "part_id")
    return out.select(F.array_join(F.transform("subset", lambda x: x.cast("string")), ",").alias("subset"), "size")


#: (strategy, role, compartment, encoding, feasibility), and carriers between compartments.
_STRATEGIES = [(s, r, "matrix" if s == "B" or (s == "C" and r < 3) else "cytosol", "mitochondrial" if s == "C" and r in (1, 2) else "nuclear", f) for s, f in (("A", 1.0), ("B", 0.7), ("C", 0.4)) for r in range(5)]
_PLAN = "(VALUES " + ", ".join(f"('{s}', {r}, '{c}', '{e}', {f})" for s, r, c, e, f in _STRATEGIES) + ") p(strategy, role, compartment, encoding, feasibility)"


#: Cofactors that a compartment supplies.
_POOLS = {"cytosol": ["NADH", "NADPH"], "matrix": ["NADH"]}
_LACKS = " + ".join(f"({p}.cofactor IN ('NADH', 'NADPH') AND NOT (at{r} = 'cytosol' OR {p}.cofactor = 'NADH'))::INT" for r, p in enumerate("abcde"))
_ROUTES = f"""WITH i AS (SELECT coalesce(list_sort(list(part_id)), []) AS a FROM v_route_part WHERE step_role = 5), m AS (SELECT a, unnest(range(0, 1 << len(a))) AS mask FROM i),
    s AS (SELECT list_filter(a, lambda x, i: (mask >> (i - 1)) & 1 = 1) AS cycle FROM m),
    g AS (SELECT strategy, max(feasibility)::DOUBLE AS feasibility, count(*) FILTER (encoding = 'mitochondrial') AS recodings, (max(compartment) FILTER (role = 2) <> max(compartment) FILTER (role = 3))::INT AS gaps,
      {", ".join(f"max(compartment) FILTER (role = {r}) AS at{r}" for r in range(5))} FROM {_PLAN} GROUP BY strategy),
    r AS (SELECT strategy || ':' || a.part_id || '+' || b.part_id || '+' || c.part_id || '+' || d.part_id || '+' || e.part_id || CASE WHEN len(cycle) > 0 THEN '+cycle:' || array_to_string(cycle, '+') ELSE '' END AS route_id, strategy, len(cycle)::INT AS cycle_size,
      {_LACKS} AS risks, gaps, recodings, feasibility
      FROM v_route_part a, v_route_part b, v_route_part c, v_route_part d, v_route_part e, s, g WHERE a.step_role = 0 AND b.step_role = 1 AND c.step_role = 2 AND d.step_role = 3 AND e.step_role = 4)"""


def _routes(t: Tables) -> DataFrame:
    strategies = t._spark.createDataFrame(_STRATEGIES, "strategy string, role int, compartment string, encoding string, feasibility double")
    carriers = t._spark.createDataFrame([("cytosol", "matrix")], "source string, target string")
    return G.enumerate_routes(t.v_route_part, strategies, [0, 1, 2, 3, 4], 5, [(0, 1), (1, 2), (2, 3), (3, 4)], carriers, _POOLS)


@query("route_enumerate", f"{_ROUTES} SELECT route_id, strategy, cycle_size, round(1.0 / (1 + risks), 6)::DOUBLE AS balance_score, round(1.0 / (1 + gaps), 6)::DOUBLE AS transport_score, feasibility FROM r")
def route_enumerate(t: Tables) -> DataFrame:
    return _routes(t).select("route_id", "strategy", F.size("cycle").alias("cycle_size"), F.round("balance_score", 6).alias("balance_score"), F.round("transport_score", 6).alias("transport_score"), "feasibility")


@query("routes_easiest", f"{_ROUTES} SELECT route_id, risks::INT AS risks, gaps::INT AS gaps FROM r ORDER BY gaps, risks, feasibility DESC, recodings, route_id LIMIT 25")
def routes_easiest(t: Tables) -> DataFrame:
    return G.ranked_routes(_routes(t)).limit(25).select("route_id", F.size("risks").alias("risks"), F.size("gaps").alias("gaps"))


@query("routes_for_programme", f"{_ROUTES} SELECT route_id, risks::INT AS risks, gaps::INT AS gaps FROM r ORDER BY gaps, risks, CASE strategy WHEN 'B' THEN 1.0 WHEN 'C' THEN 0.5 ELSE 0 END DESC, feasibility DESC, recodings, route_id LIMIT 25")
def routes_for_programme(t: Tables) -> DataFrame:
    return G.ranked_routes(_routes(t), {"B": 1.0, "C": 0.5}).limit(25).select("route_id", F.size("risks").alias("risks"), F.size("gaps").alias("gaps"))


@query(
    "insertion_plan",
    "WITH f AS (SELECT min(n_nationkey) FILTER (n_regionkey = 2) AS free, count(*) FILTER (n_regionkey <> 2 AND n_nationkey % 2 = 0) AS costly FROM nation) SELECT 'r' || part_id AS route_id, part_id AS part, n.n_name AS locus, n.n_regionkey = 2 AS keeps_respiration, f.costly AS alternatives FROM v_route_part, f JOIN nation n ON n.n_name = (SELECT min(n_name) FROM nation WHERE n_regionkey = 2) WHERE step_role IN (1, 2)",
)
def insertion_plan(t: Tables) -> DataFrame:
    loci = t.nation.select(F.col("n_name").alias("locus"), F.concat(F.lit("leader "), F.col("n_nationkey").cast("string")).alias("leader"), F.when(F.col("n_nationkey") % 2 == 0, F.array(F.lit("a"))).otherwise(F.array().cast("array<string>")).alias("activators"), F.lower("n_name").alias("displaces"), (F.col("n_regionkey") == 2).alias("free"))
    carried = t.v_route_part.where("step_role IN (1, 2)").select(F.concat(F.lit("r"), F.col("part_id").cast("string")).alias("route_id"), F.col("part_id").alias("part"))
    return G.insertion_plan(carried, loci).select("route_id", "part", "locus", "keeps_respiration", "alternatives")


@query(
    "balance_by_bucket",
    """SELECT p.reaction_id, v.tier AS compartment, round(sum(CASE WHEN p.role = 'substrate' THEN -p.coefficient ELSE p.coefficient END), 6) AS net, bool_or(v.carbons < 3) AS unknown,
    CASE WHEN bool_or(v.carbons < 3) THEN 'unknown' WHEN abs(sum(CASE WHEN p.role = 'substrate' THEN -p.coefficient ELSE p.coefficient END)) < 1e-9 THEN 'balanced' ELSE 'unbalanced' END AS status
    FROM v_participant p JOIN v_product v ON v.product_id = p.metabolite_id GROUP BY p.reaction_id, v.tier""",
)
def balance_by_bucket(t: Tables) -> DataFrame:
    j = t.v_participant.join(t.v_product.select(F.col("product_id").alias("metabolite_id"), F.col("tier").alias("compartment"), "carbons"), "metabolite_id")
    net = F.sum(F.when(F.col("role") == "substrate", -F.col("coefficient")).otherwise(F.col("coefficient")))
    unknown = F.bool_or(F.col("carbons") < 3)  # unknown beats balanced
    g = j.groupBy("reaction_id", "compartment").agg(F.round(net, 6).alias("net"), unknown.alias("unknown"), F.when(unknown, "unknown").when(F.abs(net) < 1e-9, "balanced").otherwise("unbalanced").alias("status"))
    return g


@query(
    "transport_gaps",
    """WITH s AS (SELECT p.reaction_id, v.tier AS c, lead(v.tier) OVER (PARTITION BY p.reaction_id ORDER BY p.line, p.metabolite_id) AS n FROM v_participant p JOIN v_product v ON v.product_id = p.metabolite_id)
    SELECT DISTINCT reaction_id, c AS source, n AS target FROM s WHERE n <> c AND NOT (c = 'Brand#11' AND n = 'Brand#12') AND NOT (c = 'Brand#13' AND n = 'Brand#21')""",
)
def transport_gaps(t: Tables) -> DataFrame:
    tiers = t.v_product.select(F.col("product_id").alias("metabolite_id"), F.col("tier").alias("compartment"))
    steps = t.v_participant.join(tiers, "metabolite_id").withColumn("place", F.struct("line", "metabolite_id"))
    carriers = t._spark.createDataFrame([("Brand#11", "Brand#12"), ("Brand#13", "Brand#21")], "source string, target string")
    return G.transport_gaps(steps, "reaction_id", "place", "compartment", carriers)


@query(
    "cofactor_demand",
    "SELECT route_id, compartment, cofactor, count(*) AS demand, compartment = 'cytosol' OR cofactor = 'NADH' AS supplied FROM v_route_step WHERE step_role <> 5 AND cofactor IN ('NADH', 'NADPH') GROUP BY route_id, compartment, cofactor",
)
def cofactor_demand(t: Tables) -> DataFrame:
    return G.cofactor_demand(t.v_route_step, _POOLS, 5)


@query("gate_rules", "SELECT s.strain_id, r.rule, r.effect FROM v_strain s JOIN (VALUES ('low_score', 'exclude', -1000.0, 0.0), ('mid_score', 'burden', 0.0, 3000.0)) r(rule, effect, lo, hi) ON s.score >= r.lo AND s.score < r.hi")
def gate_rules(t: Tables) -> DataFrame:
    rules = t._spark.createDataFrame([("low_score", "exclude", -1000.0, 0.0), ("mid_score", "burden", 0.0, 3000.0)], "rule string, effect string, lo double, hi double")
    return t.v_strain.join(F.broadcast(rules), (F.col("score") >= F.col("lo")) & (F.col("score") < F.col("hi"))).select("strain_id", "rule", "effect")


@query("reaction_balance", "SELECT reaction_id, sum(CASE WHEN role = 'substrate' THEN -1 ELSE 1 END * carbons * coefficient) AS carbon_net, count(*) FILTER (role = 'substrate') > 0 AND count(*) FILTER (role = 'product') > 0 AS two_sided FROM v_participant p JOIN v_product v ON v.product_id = p.metabolite_id GROUP BY reaction_id")
def reaction_balance(t: Tables) -> DataFrame:
    j = t.v_participant.join(t.v_product.select(F.col("product_id").alias("metabolite_id"), "carbons"), "metabolite_id")
    sign = F.when(F.col("role") == "substrate", -1).otherwise(1)
    sides = (F.count_if(F.col("role") == "substrate") > 0) & (F.count_if(F.col("role") == "product") > 0)
    return j.groupBy("reaction_id").agg(F.sum(sign * F.col("carbons") * F.col("coefficient")).alias("carbon_net"), sides.alias("two_sided"))


@query("locus_filter", "SELECT part_id FROM v_route_part WHERE compartment <> 'Brand#11' AND NOT contains(enzyme, 'STEEL')")
def locus_filter(t: Tables) -> DataFrame:
    return t.v_route_part.where((F.col("compartment") != "Brand#11") & ~F.col("enzyme").contains("STEEL")).select("part_id")


@query(
    "literature_recall",
    """WITH e AS (SELECT DISTINCT config_id, entry, list_distinct(regexp_extract_all(lower(entry), '[a-z][a-z0-9]*')) AS toks, regexp_extract_all(lower(entry), '[a-z0-9]+') AS runs FROM v_config_entry),
    n AS (SELECT *, list_concat(runs, list_transform(range(1, len(runs)), lambda i: runs[i] || runs[i + 1])) AS named, lower(replace(regexp_extract(entry, 'from ([A-Z](?:[a-z]+|\\.)) ([a-z]{2,})', 1), '.', '')) AS genus,
      regexp_extract(entry, 'from ([A-Z](?:[a-z]+|\\.)) ([a-z]{2,})', 2) AS species, list_filter(toks, lambda t: t IN ('step0', 'step1', 'step2', 'step3', 'step4')) AS rt FROM e),
    h AS (SELECT DISTINCT n.config_id, n.entry, c.part_id, c.step_role AS role, list_contains(n.named, c.designation) AS has FROM (SELECT *, unnest(toks) AS tok FROM n) n JOIN v_catalog c ON c.gene = CASE n.tok WHEN 'genz' THEN 'gen7' ELSE n.tok END),
    g AS (SELECT config_id, entry, role, list_sort(list(part_id)) AS every, list_sort(list(part_id) FILTER (has)) AS having_it FROM h GROUP BY ALL),
    k AS (SELECT config_id, entry, role, CASE WHEN len(every) > 1 AND len(having_it) > 1 THEN 'ambiguous_variant' WHEN len(every) > 1 AND len(having_it) = 1 THEN 'variant' ELSE 'gene' END AS outcome, CASE WHEN len(every) > 1 AND len(having_it) > 0 THEN having_it ELSE every END AS ids FROM g),
    s AS (SELECT n.config_id, n.entry, any_value(CASE WHEN len(rt) = 1 AND NOT list_contains(toks, 'stepfamily') AND genus <> '' THEN substr(rt[1], 5)::INT END) AS role, any_value(len(rt) > 0 OR list_contains(toks, 'stepfamily')) AS names_role,
      list_sort(list(c.part_id) FILTER (c.part_id IS NOT NULL)) AS ids FROM n LEFT JOIN v_catalog c ON len(rt) = 1 AND NOT list_contains(toks, 'stepfamily') AND genus <> '' AND c.step_role = substr(rt[1], 5)::INT
        AND lower(split_part(c.organism, ' ', 2)) = species AND (lower(split_part(c.organism, ' ', 1)) = genus OR len(genus) = 1 AND lower(c.organism[1]) = genus)
      WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.config_id = n.config_id AND g.entry = n.entry) GROUP BY 1, 2),
    o AS (SELECT config_id, role, outcome, ids FROM k UNION ALL SELECT config_id, role, CASE WHEN len(ids) = 1 THEN 'source' WHEN len(ids) > 1 THEN 'ambiguous_source' WHEN names_role THEN 'role_only' ELSE 'unrecognised' END, ids FROM s),
    f AS (SELECT config_id, role, list_distinct(flatten(list(ids))) AS ids FROM o WHERE outcome IN ('gene', 'variant', 'source') AND role < 5 GROUP BY 1, 2),
    q AS (SELECT config_id, count(*) FILTER (outcome = 'unrecognised') AS unknown, list_distinct(list(role) FILTER (outcome = 'ambiguous_source')) AS src, list_distinct(list(role) FILTER (outcome = 'ambiguous_variant')) AS var FROM o GROUP BY 1),
    m AS (SELECT c.config_id, r.route_id FROM v_config c JOIN f USING (config_id) JOIN v_config_route r ON r.strategy = c.strategy AND r.role = f.role AND list_contains(f.ids, r.part_id)
      WHERE c.host IS NOT NULL AND c.host_organism = 'yeast' GROUP BY 1, 2 HAVING count(*) = (SELECT count(*) FROM f x WHERE x.config_id = c.config_id)),
    w AS (SELECT config_id, count(*) AS n_routes FROM m GROUP BY 1), z AS (SELECT config_id, list(role) AS filled, list_sort(list(role) FILTER (len(ids) > 1)) AS several FROM f GROUP BY 1),
    v AS (SELECT c.config_id, coalesce(n_routes, 0) AS n_routes, list_filter([0, 1, 2, 3, 4], lambda r: NOT list_contains(coalesce(filled, []), r)) AS unfilled, coalesce(several, []) AS several, coalesce(unknown, 0) AS unknown, src, var,
      CASE WHEN strategy IS NULL OR strategy = 'Z' THEN 'strategy_not_enumerable' WHEN host IS NULL THEN 'host_not_recorded' WHEN host_organism <> 'yeast' THEN 'host_outside_enumeration' WHEN q.config_id IS NULL THEN 'no_enzyme_set_recorded' END AS early
      FROM v_config c LEFT JOIN w USING (config_id) LEFT JOIN z USING (config_id) LEFT JOIN q USING (config_id)),
    t AS (SELECT *, CASE WHEN early IS NOT NULL THEN early WHEN len(unfilled) = 0 AND n_routes > 0 THEN 'matched' WHEN unknown > 0 THEN 'catalog_gap' WHEN list_has_any(coalesce(src, []), unfilled) THEN 'source_organism_ambiguous'
      WHEN list_has_any(coalesce(var, []), unfilled) THEN 'variant_designation_ambiguous' ELSE 'under_specified' END AS clause FROM v)
    SELECT config_id, clause, CASE WHEN early IS NULL THEN n_routes ELSE 0 END AS n_routes, CASE WHEN early IS NULL THEN array_to_string(unfilled, ',') END AS unfilled, CASE WHEN early IS NULL THEN array_to_string(several, ',') END AS ambiguous,
      clause = 'matched' OR clause = 'under_specified' AND n_routes > 0 AS partial FROM t""",
)
def literature_recall(t: Tables) -> DataFrame:
    parts = t.v_catalog.select("part_id", "step_role", F.array("gene").alias("genes"), F.array_compact(F.array("designation")).alias("designations"), "organism")
    out = R.classify(t.v_config, t.v_config_entry, parts, t.v_config_route, range(5), ["A", "B", "C"], "yeast", {"genz": "gen7"}, {f"step{r}": r for r in range(5)}, ["stepfamily"])
    text = lambda c: F.when(F.col(c).isNotNull(), F.array_join(F.transform(c, lambda x: x.cast("string")), ",")).alias(c)
    return out.select("config_id", "clause", "n_routes", text("unfilled"), text("ambiguous"), "partial")


@query(
    "relational_division",
    """WITH w AS (SELECT DISTINCT l_suppkey AS wish, l_returnflag || l_linestatus || l_linenumber AS item FROM lineitem WHERE l_quantity > 49), h AS (SELECT DISTINCT l_orderkey AS owner, l_returnflag || l_linestatus || l_linenumber AS item FROM lineitem)
    SELECT w.wish, h.owner FROM w JOIN h ON w.item = h.item GROUP BY w.wish, h.owner HAVING count(*) = (SELECT count(*) FROM w x WHERE x.wish = w.wish)""",
)
def relational_division(t: Tables) -> DataFrame:
    item = F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")).alias("item")
    want = t.lineitem.where("l_quantity > 49").select(F.col("l_suppkey").alias("wish"), item).distinct()
    return G.relational_division(t.lineitem.select(F.col("l_orderkey").alias("owner"), item), want, "owner", "item", "wish")


_TRACE = [("no_sample", "m.sample_id IS NULL"), ("no_order", "o.o_orderkey IS NULL"), ("no_customer", "c.c_custkey IS NULL"), ("quarantined", "f.target_id IS NOT NULL")]


@query(
    "trace_breaks",
    "SELECT m.measurement_id, m.product_id, concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{k}' END" for k, c in _TRACE) + """) AS breaks
    FROM v_measurement m LEFT JOIN orders o ON o.o_orderkey = m.sample_id AND o.o_orderkey % 9 <> 0 LEFT JOIN customer c ON c.c_custkey = o.o_custkey AND c.c_custkey % 7 <> 0 LEFT JOIN v_flag f ON f.target_id = m.strain_id AND f.status = 'active'""",
)
def trace_breaks(t: Tables) -> DataFrame:
    c = t.customer.where("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("has_customer"))
    o = t.orders.where("o_orderkey % 9 <> 0").join(c, "o_custkey", "left").select(F.col("o_orderkey").alias("sample_id"), F.lit(0).alias("_spread"), F.lit(True).alias("has_order"), "has_customer")
    f = t.v_flag.where("status = 'active'").select(F.col("target_id").alias("strain_id"), F.lit(True).alias("held"))
    # rows without a sample find none; a second key, which no order has, spreads them over the tasks
    m = t.v_measurement.withColumn("_spread", F.when(F.col("sample_id").isNull(), 1 + F.pmod(F.xxhash64("measurement_id"), F.lit(4096)).cast("int")).otherwise(0))
    j = m.join(o, ["sample_id", "_spread"], "left").join(f, "strain_id", "left")
    tests = {"no_sample": F.col("sample_id").isNull(), "no_order": F.col("has_order").isNull(), "no_customer": F.col("has_customer").isNull(), "quarantined": F.col("held").isNotNull()}
    return j.select("measurement_id", "product_id", F.concat_ws(",", *(F.when(x, F.lit(k)) for k, x in tests.items())).alias("breaks"))


_KINDS = {"paper": "publication", "strain": "strain", "run": "processing_run"}
_CITED = {"publication_id": "publication", "span_id": "span", "extraction_id": "extraction", "measurement_id": "measurement", "analysis_result_id": "analysis_result", "processing_run_id": "processing_run", "strain_id": "strain"}


@query(
    "provenance_walk",
    "WITH j AS (SELECT e.*, " + ", ".join(f"e.{c} IS NOT NULL AND k_{c}.id IS NOT NULL AS has_{c}, e.{c} IS NOT NULL AND k_{c}.id IS NULL AS lost_{c}" for c in _CITED) + """,
      k_span_id.publication_id AS span_paper, sp.id IS NOT NULL AS span_paper_there, k_extraction_id.publication_id AS extraction_paper, ep.id IS NOT NULL AS extraction_paper_there,
      k_analysis_result_id.dataset_id AS deposit, ad.id IS NOT NULL AS deposit_there, ar.id IS NOT NULL AS run_there FROM v_cited e """
    + " ".join(f"LEFT JOIN v_citable k_{c} ON k_{c}.kind = '{k}' AND k_{c}.id = e.{c}" for c, k in _CITED.items())
    + """ LEFT JOIN v_citable sp ON sp.kind = 'publication' AND sp.id = k_span_id.publication_id LEFT JOIN v_citable ep ON ep.kind = 'publication' AND ep.id = k_extraction_id.publication_id
      LEFT JOIN v_citable ar ON ar.kind = 'processing_run' AND ar.id = k_analysis_result_id.processing_run_id LEFT JOIN v_citable ad ON ad.kind = 'dataset' AND ad.id = k_analysis_result_id.dataset_id WHERE e.status = 'active'),
    b AS (SELECT *, has_span_id AND span_paper_there AND publication_id IS NOT NULL AND span_paper <> publication_id AS span_wrong, has_extraction_id AND extraction_paper_there AND publication_id IS NOT NULL AND extraction_paper <> publication_id AS extraction_wrong,
      """ + " + ".join(f"lost_{c}::INT" for c in _CITED) + """ + (has_span_id AND NOT span_paper_there)::INT + (has_extraction_id AND NOT extraction_paper_there)::INT + (has_analysis_result_id AND NOT run_there)::INT
      + (has_analysis_result_id AND deposit IS NOT NULL AND NOT deposit_there)::INT AS dangling FROM j),
    c AS (SELECT *, has_publication_id OR (has_span_id AND span_paper_there AND NOT coalesce(span_wrong, false)) OR (has_extraction_id AND extraction_paper_there AND NOT coalesce(extraction_wrong, false))
      OR CASE WHEN has_analysis_result_id THEN run_there ELSE has_processing_run_id END AS closed FROM b),
    e AS (SELECT assertion_id, count(*) AS n_evidence, sum(dangling) AS dangling_citation, count(*) FILTER (span_wrong) AS span_publication_mismatch, count(*) FILTER (extraction_wrong) AS extraction_publication_mismatch,
      count(*) FILTER (NOT closed AND (coalesce(publication_id, span_id, extraction_id, analysis_result_id, processing_run_id) IS NULL OR dangling = 0 AND NOT span_wrong AND NOT extraction_wrong)) AS evidence_cites_nothing,
      count(*) FILTER ((has_analysis_result_id OR has_processing_run_id) AND NOT (has_analysis_result_id AND deposit IS NOT NULL)) AS gaps FROM c GROUP BY 1),
    v AS (SELECT target_id, count(*) FILTER (trim(curator) <> '') AS named FROM v_curation GROUP BY 1),
    r AS (SELECT a.assertion_id, coalesce(n_evidence, 0) AS n_evidence, coalesce(gaps, 0)::BIGINT AS gaps, (n_evidence IS NULL)::BIGINT AS no_evidence,
      (s.id IS NULL)::BIGINT AS dangling_subject, (object_type <> 'literal' AND o.id IS NULL)::BIGINT AS dangling_object, coalesce(evidence_cites_nothing, 0) AS evidence_cites_nothing, coalesce(dangling_citation, 0)::BIGINT AS dangling_citation,
      coalesce(span_publication_mismatch, 0) AS span_publication_mismatch, coalesce(extraction_publication_mismatch, 0) AS extraction_publication_mismatch, (v.target_id IS NULL)::BIGINT AS no_curation_event, coalesce(named = 0, false)::BIGINT AS curation_event_unnamed
      FROM v_statement a LEFT JOIN e USING (assertion_id) LEFT JOIN v ON v.target_id = a.assertion_id
      LEFT JOIN v_citable s ON s.id = subject_id AND s.kind = CASE subject_type WHEN 'paper' THEN 'publication' WHEN 'strain' THEN 'strain' END LEFT JOIN v_citable o ON o.id = object_id AND o.kind = 'processing_run' AND object_type = 'run' WHERE a.status = 'active')
    SELECT *, no_evidence + dangling_subject + dangling_object + evidence_cites_nothing + dangling_citation + span_publication_mismatch + extraction_publication_mismatch + no_curation_event + curation_event_unnamed = 0 AS complete FROM r""",
)
def provenance_walk(t: Tables) -> DataFrame:
    return P.walk_assertions(t.v_statement, t.v_cited, t.v_citable, t.v_curation, _KINDS, _KINDS)
