"""Entity readers: compositions of the operators, one DataFrame each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.registry import query
from quillon.sources.standins import Tables


@query("strain_list", "SELECT s.strain_id, s.canonical_name, n.n_name AS organism, coalesce(m.n, 0) AS measurements, coalesce(f.n, 0) AS flags FROM v_strain s JOIN nation n ON n.n_nationkey = s.organism_id LEFT JOIN (SELECT strain_id, count(*) AS n FROM v_measurement GROUP BY 1) m ON m.strain_id = s.strain_id LEFT JOIN (SELECT target_id, count(*) AS n FROM v_flag GROUP BY 1) f ON f.target_id = s.strain_id")
def strain_list(t: Tables) -> DataFrame:
    m = t.v_measurement.groupBy("strain_id").agg(F.count("*").alias("measurements"))
    f = t.v_flag.groupBy(F.col("target_id").alias("strain_id")).agg(F.count("*").alias("flags"))
    s = t.v_strain.join(t.nation, F.col("organism_id") == F.col("n_nationkey")).join(m, "strain_id", "left").join(f, "strain_id", "left")
    return s.na.fill(0, ["measurements", "flags"]).select("strain_id", "canonical_name", F.col("n_name").alias("organism"), "measurements", "flags")


@query("experiment_list", "SELECT o.o_orderkey AS experiment_id, c.c_name AS customer, count(l.l_linenumber) AS samples, o.o_orderdate >= TIMESTAMP '1996-01-01' AS recent FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY ALL")
def experiment_list(t: Tables) -> DataFrame:
    n = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("samples"))
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(n, "o_orderkey", "left").na.fill(0, ["samples"])
    return o.select(F.col("o_orderkey").alias("experiment_id"), F.col("c_name").alias("customer"), "samples", (F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz")).alias("recent"))


@query("product_list", "SELECT p.product_id, p.name, count(m.measurement_id) AS n, max(m.value) AS best FROM v_product p LEFT JOIN v_measurement m ON m.product_id = p.product_id GROUP BY p.product_id, p.name")
def product_list(t: Tables) -> DataFrame:
    m = t.v_measurement.groupBy("product_id").agg(F.count("*").alias("n"), F.max("value").alias("best"))
    return t.v_product.join(m, "product_id", "left").na.fill(0, ["n"]).select("product_id", "name", "n", "best")


@query("gene_page", "SELECT p.product_id, p.name, count(DISTINCT r.reaction_id) AS reactions, count(*) FILTER (r.role = 'substrate') AS as_substrate FROM v_product p JOIN v_participant r ON r.metabolite_id = p.product_id GROUP BY p.product_id, p.name")
def gene_page(t: Tables) -> DataFrame:
    p = t.v_product.join(t.v_participant, F.col("metabolite_id") == F.col("product_id"))
    return p.groupBy("product_id", "name").agg(F.count_distinct("reaction_id").alias("reactions"), F.count_if(F.col("role") == "substrate").alias("as_substrate"))


@query("dual_coded", "SELECT p_brand AS compartment, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS genomes, count(DISTINCT p_type) > 1 AS dual FROM part GROUP BY p_brand")
def dual_coded(t: Tables) -> DataFrame:
    kinds = F.array_sort(F.collect_set("p_type"))
    return t.part.groupBy(F.col("p_brand").alias("compartment")).agg(F.array_join(kinds, ",").alias("genomes"), (F.size(kinds) > 1).alias("dual"))


@query("runs_list", "SELECT event_id, user_id, value FROM events WHERE event_type = 'signup' AND value > 100 ORDER BY value DESC, event_id LIMIT 100")
def runs_list(t: Tables) -> DataFrame:
    return t.events.where("event_type = 'signup' AND value > 100").orderBy(F.col("value").desc(), "event_id").limit(100).select("event_id", "user_id", "value")


@query("route_page", "SELECT reaction_id, count(*) AS steps, count(DISTINCT v.tier) AS compartments, round(avg(coefficient), 6) AS mean FROM v_participant p JOIN v_product v ON v.product_id = p.metabolite_id GROUP BY reaction_id")
def route_page(t: Tables) -> DataFrame:
    v = t.v_product.select(F.col("product_id").alias("metabolite_id"), "tier")
    return t.v_participant.join(v, "metabolite_id").groupBy("reaction_id").agg(F.count("*").alias("steps"), F.count_distinct("tier").alias("compartments"), F.round(F.avg("coefficient"), 6).alias("mean"))


@query("data_overview", "SELECT quantity_kind, unit, count(*) AS n, count(sample_id) AS sampled, round(avg(value), 6) AS mean FROM v_measurement GROUP BY quantity_kind, unit")
def data_overview(t: Tables) -> DataFrame:
    return t.v_measurement.groupBy("quantity_kind", "unit").agg(F.count("*").alias("n"), F.count("sample_id").alias("sampled"), F.round(F.avg("value"), 6).alias("mean"))
