"""Conservation of reactions and redox balance of routes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators import balance as B
from quillon.registry import query
from quillon.sources.standins import Tables


@query(
    "reaction_conservation",
    """WITH j AS (SELECT p.reaction_id, p.role, p.coefficient AS k, m.carbons, m.pair, m.redox, m.adenylate, m.metabolite_id IS NULL AS stranger
      FROM v_reaction_part p LEFT JOIN v_metabolite m USING (metabolite_id) WHERE p.role <> 'cofactor'),
    n AS (SELECT reaction_id, count(*) FILTER (stranger) AS strangers, sum(CASE role WHEN 'substrate' THEN -1 ELSE 1 END * coalesce(carbons, 0) * k) AS carbon,
      coalesce(sum(k) FILTER (role = 'substrate' AND pair = 'nad' AND redox = 'reduced'), 0) - coalesce(sum(k) FILTER (role = 'product' AND pair = 'nad' AND redox = 'oxidized'), 0) AS nad_spent,
      coalesce(sum(k) FILTER (role = 'substrate' AND pair = 'nad' AND redox = 'oxidized'), 0) - coalesce(sum(k) FILTER (role = 'product' AND pair = 'nad' AND redox = 'reduced'), 0) AS nad_made,
      coalesce(sum(k) FILTER (role = 'substrate' AND pair = 'nadp' AND redox = 'reduced'), 0) - coalesce(sum(k) FILTER (role = 'product' AND pair = 'nadp' AND redox = 'oxidized'), 0) AS nadp_spent,
      coalesce(sum(k) FILTER (role = 'substrate' AND pair = 'nadp' AND redox = 'oxidized'), 0) - coalesce(sum(k) FILTER (role = 'product' AND pair = 'nadp' AND redox = 'reduced'), 0) AS nadp_made,
      coalesce(sum(CASE role WHEN 'substrate' THEN -k ELSE k END) FILTER (pair IN ('nad', 'nadp') AND redox IN ('reduced', 'oxidized')), 0) AS carriers,
      coalesce(sum(k) FILTER (role = 'substrate' AND adenylate = 'charged'), 0) - coalesce(sum(k) FILTER (role = 'product' AND adenylate = 'discharged'), 0) AS adenylate
      FROM j GROUP BY reaction_id)
    SELECT r.reaction_id, concat_ws(',', CASE WHEN strangers > 0 THEN 'undeclared' END, CASE WHEN carbon <> 0 THEN 'carbon' END, CASE WHEN NOT transfers AND (nad_spent <> 0 OR nad_made <> 0) THEN 'nad redox' END,
      CASE WHEN NOT transfers AND (nadp_spent <> 0 OR nadp_made <> 0) THEN 'nadp redox' END, CASE WHEN carriers <> 0 THEN 'redox carriers' END, CASE WHEN adenylate <> 0 THEN 'adenylate' END) AS problems, coalesce(carbon, 0)::DOUBLE AS carbon_net
    FROM v_reaction r LEFT JOIN n USING (reaction_id)""",
)
def reaction_conservation(t: Tables) -> DataFrame:
    out = B.conservation(t.v_reaction_part, t.v_metabolite, t.v_reaction)
    return out.select("reaction_id", F.concat_ws(",", "problems").alias("problems"), (F.col("carbon_out") - F.col("carbon_in")).alias("carbon_net"))


@query(
    "redox_balance",
    """WITH q AS (SELECT p.reaction_id, m.pair, sum(CASE p.role WHEN 'product' THEN p.coefficient WHEN 'substrate' THEN -p.coefficient END) AS net, count(*) FILTER (p.role = 'cofactor') AS loose
      FROM v_reaction_part p JOIN v_metabolite m USING (metabolite_id) WHERE m.redox = 'reduced' AND m.pair IS NOT NULL GROUP BY 1, 2),
    e AS (SELECT reaction_id, coalesce(sum(net) FILTER (pair = 'nad'), 0) AS nadh, coalesce(sum(net) FILTER (pair = 'nadp'), 0) AS nadph, bool_or(pair NOT IN ('nad', 'nadp') AND coalesce(net, 0) <> 0) AS nameless,
      coalesce(max(net) FILTER (pair = 'fad'), 0) AS fad, sum(loose) > 0 AS loose FROM q GROUP BY 1),
    c AS (SELECT s.*, r.reaction_id, r.transfers, coalesce(e.nadh, 0) AS nadh, coalesce(e.nadph, 0) AS nadph, coalesce(e.nameless, false) AS nameless, coalesce(e.fad, 0) AS fad, coalesce(e.loose, false) AS loose, lower(r.gene) = lower(s.gene) AS hit
      FROM v_route_step s LEFT JOIN v_reaction r ON r.pathway_id = s.pathway_id AND r.step_role = s.step_role LEFT JOIN e USING (reaction_id)),
    h AS (SELECT *, count(reaction_id) OVER w AS n, count(*) FILTER (hit) OVER w AS hits FROM c WINDOW w AS (PARTITION BY route_id, step_role)),
    k AS (SELECT * FROM h WHERE n < 2 OR hits <> 1 OR hit),
    a AS (SELECT route_id, step_role, any_value(part_id) AS part_id, any_value(compartment) AS compartment, any_value(cofactor) AS cofactor, count(reaction_id) AS n, bool_or(loose) AS loose,
      count(DISTINCT nadh || '|' || nadph || '|' || fad) AS kinds, arg_min(nadh, reaction_id) AS nadh, arg_min(nadph, reaction_id) AS nadph, bool_or(nameless) AS nameless, bool_or(transfers) FILTER (reaction_id = least_id) AS transfers
      FROM (SELECT *, min(reaction_id) OVER (PARTITION BY route_id, step_role) AS least_id FROM k) GROUP BY 1, 2),
    b AS (SELECT *, (nadh <> 0)::INT + (nadph <> 0)::INT AS touched, CASE WHEN n = 0 THEN 'no reaction' WHEN loose THEN 'no direction' WHEN kinds > 1 THEN 'reactions disagree' WHEN nameless THEN 'pool without a name'
      WHEN transfers AND nadh + nadph <> 0 THEN 'transfer does not conserve' WHEN NOT transfers AND nadh = 0 AND nadph = 0 AND cofactor <> 'NA' THEN 'amount not recorded'
      WHEN NOT transfers AND (nadh <> 0 OR nadph <> 0) AND cofactor IN ('unknown', 'either') THEN 'pool not recorded' WHEN NOT transfers AND (nadh <> 0 OR nadph <> 0) AND cofactor = 'NA' THEN 'part and pathway disagree'
      WHEN NOT transfers AND nadh <> 0 AND nadph <> 0 THEN 'two pools' END AS unknown FROM a),
    t AS (SELECT route_id, compartment, CASE WHEN transfers THEN 'NADH' ELSE cofactor END AS cofactor, CASE WHEN transfers THEN nadh ELSE nadh + nadph END AS net FROM b WHERE unknown IS NULL AND touched > 0
      UNION ALL SELECT route_id, compartment, 'NADPH', nadph FROM b WHERE unknown IS NULL AND transfers AND touched > 0),
    o AS (SELECT route_id, string_agg(compartment || ' ' || cofactor || ' ' || net::BIGINT, '; ' ORDER BY abs(net) DESC, compartment, cofactor) AS open_buckets FROM (SELECT route_id, compartment, cofactor, sum(net) AS net FROM t GROUP BY 1, 2, 3) WHERE net <> 0 GROUP BY 1),
    u AS (SELECT route_id, coalesce(string_agg(step_role || ' ' || part_id || ' ' || unknown, '; ' ORDER BY step_role, part_id), '') AS unknowns,
      coalesce(string_agg(step_role || ' ' || part_id || ' ' || CASE WHEN nadh <> 0 THEN 'NADH' ELSE 'NADPH' END || ' to ' || cofactor, '; ' ORDER BY step_role, part_id) FILTER (unknown IS NULL AND NOT transfers AND touched = 1 AND cofactor <> CASE WHEN nadh <> 0 THEN 'NADH' ELSE 'NADPH' END), '') AS substitutions FROM b GROUP BY 1)
    SELECT u.route_id, CASE WHEN unknowns <> '' THEN 'unknown' WHEN open_buckets IS NOT NULL THEN 'unbalanced' ELSE 'balanced' END AS status, coalesce(open_buckets, '') AS open_buckets, unknowns, substitutions FROM u LEFT JOIN o USING (route_id)""",
)
def redox_balance(t: Tables) -> DataFrame:
    steps = t.v_route_step.withColumn("genes", F.array("gene")).drop("gene")
    out = B.redox_balance(steps, t.v_reaction.withColumn("genes", F.array("gene")), t.v_reaction_part, t.v_metabolite)
    text = lambda c, *fields: F.array_join(F.transform(c, lambda x: F.concat_ws(" ", *(x[f].cast("bigint" if f == "net" else "string").cast("string") for f in fields))), "; ").alias(c)
    return out.select("route_id", "status", text("open_buckets", "compartment", "cofactor", "net"), text("unknowns", "step_role", "part_id", "reason"), text("substitutions", "step_role", "part_id", "change"))
