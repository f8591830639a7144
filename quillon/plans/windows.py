"""Window and ordered-analytic queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import sequence as Q
from quillon.operators import relational as R
from quillon.operators import statistics as S
from quillon.registry import query
from quillon.sources.standins import Tables


@query("first_per_group", "SELECT product_id, strain_id, value FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY value DESC, measurement_id, strain_id) AS rn FROM v_measurement) x WHERE rn = 1")
def first_per_group(t: Tables) -> DataFrame:
    return R.first_rows(t.v_measurement, ["product_id"], ["-value", "measurement_id", "strain_id"]).select("product_id", "strain_id", "value")


@query("best_per_class", "SELECT feedstock, context_id, sugar FROM (SELECT *, row_number() OVER (PARTITION BY feedstock ORDER BY sugar DESC, context_id) AS rn FROM v_context) x WHERE rn = 1")
def best_per_class(t: Tables) -> DataFrame:
    # of equal values the first seen wins; as one aggregate, so that a large class is summed before the shuffle
    best = F.max(F.struct("sugar", (-F.col("context_id")).alias("neg")))
    return t.v_context.groupBy("feedstock").agg(best.alias("b")).select("feedstock", (-F.col("b.neg")).alias("context_id"), "b.sugar")


@query("first_with_count", "SELECT step_role, part_id, variants FROM (SELECT step_role, part_id, count(*) OVER (PARTITION BY step_role) AS variants, row_number() OVER (PARTITION BY step_role ORDER BY part_id) AS rn FROM v_route_part) x WHERE rn = 1")
def first_with_count(t: Tables) -> DataFrame:
    return R.first_rows(t.v_route_part, ["step_role"], ["part_id"], "variants").select("step_role", "part_id", "variants")


_P = "SELECT p_partkey AS id, p_brand AS contrast, ((p_partkey * 7919) % 10007 + 1) / 10008.0 AS p FROM part"


@query(
    "bh_fdr",
    f"""WITH p AS ({_P}), r AS (SELECT *, row_number() OVER (PARTITION BY contrast ORDER BY p, id) AS rn, count(*) OVER (PARTITION BY contrast) AS n FROM p)
    SELECT id, round(least(1.0, min(p * n / rn) OVER (PARTITION BY contrast ORDER BY rn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::DOUBLE, 8) AS q FROM r""",
)
def bh_fdr(t: Tables) -> DataFrame:
    p = t.part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("contrast"), (((F.col("p_partkey") * 7919) % 10007 + 1) / F.lit(10008.0)).alias("p"))
    return S.benjamini_hochberg(p, ["contrast"], "p", "id").select("id", F.round("q", 8).alias("q"))


@query(
    "largest_gap_split",
    """WITH g AS (SELECT gene, n, lead(n) OVER (PARTITION BY gene ORDER BY n, sample) AS top FROM v_matrix), b AS (SELECT gene, max((top - n, n, top)) AS b FROM g WHERE top IS NOT NULL AND n > 0 GROUP BY gene)
    SELECT m.gene, b[2] AS edge, count(*) FILTER (m.n <= b[2]) AS low, count(*) FILTER (m.n > b[2]) AS high FROM v_matrix m JOIN b ON m.gene = b.gene WHERE b[3] >= 4 * b[2] GROUP BY m.gene, b[2]""",
)
def largest_gap_split(t: Tables) -> DataFrame:
    j = t.v_matrix.join(S.largest_gap(t.v_matrix, ["gene"], "n", "sample"), "gene")
    return j.groupBy("gene", "edge").agg(F.count_if(F.col("n") <= F.col("edge")).alias("low"), F.count_if(F.col("n") > F.col("edge")).alias("high"))


@query("neighbours_range", "SELECT feature_id, count(*) OVER (PARTITION BY seqid ORDER BY start_pos RANGE BETWEEN 1000 PRECEDING AND 1000 FOLLOWING) - 1 AS neighbours FROM v_feature")
def neighbours_range(t: Tables) -> DataFrame:
    near = Window.partitionBy("seqid").orderBy("start_pos").rangeBetween(-1000, 1000)
    return t.v_feature.select("feature_id", (F.count("*").over(near) - 1).alias("neighbours"))


@query("minmax_norm", "SELECT product_id, round(CASE WHEN max(ceiling) OVER w = min(ceiling) OVER w THEN 1.0 ELSE (ceiling - min(ceiling) OVER w) / (max(ceiling) OVER w - min(ceiling) OVER w) END, 8) AS scaled FROM v_product WINDOW w AS (PARTITION BY tier)")
def minmax_norm(t: Tables) -> DataFrame:
    w = Window.partitionBy("tier")
    low, high = F.min("ceiling").over(w), F.max("ceiling").over(w)
    return t.v_product.select("product_id", F.round(F.when(high == low, 1.0).otherwise(F.try_divide(F.col("ceiling") - low, high - low)), 8).alias("scaled"))


@query(
    "robust_z",
    """WITH m AS (SELECT feedstock, median(sugar) AS med FROM v_context GROUP BY feedstock), d AS (SELECT c.*, m.med, abs(c.sugar - m.med) AS dev FROM v_context c JOIN m ON c.feedstock = m.feedstock),
    a AS (SELECT feedstock, median(dev) AS mad FROM d GROUP BY feedstock)
    SELECT d.context_id, round(CASE WHEN a.mad = 0 THEN 0 ELSE (d.sugar - d.med) / (1.4826 * a.mad) END, 6) AS z FROM d JOIN a ON d.feedstock = a.feedstock""",
)
def robust_z(t: Tables) -> DataFrame:
    return S.robust_z(t.v_context, ["feedstock"], "sugar").select("context_id", F.round("z", 6).alias("z"))


@query(
    "prev_rejected",
    """SELECT o.o_orderkey AS task_id, min(p.o_orderkey) AS repeat_of FROM orders o JOIN (SELECT o_custkey, arg_min(o_orderkey, struct_pack(d := o_orderdate, k := o_orderkey)) AS o_orderkey FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey) p
    ON o.o_custkey = p.o_custkey WHERE o.o_orderstatus = 'O' GROUP BY o.o_orderkey""",
)
def prev_rejected(t: Tables) -> DataFrame:
    first = t.orders.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.min(F.struct("o_orderdate", "o_orderkey"))["o_orderkey"].alias("repeat_of"))
    return t.orders.where("o_orderstatus = 'O'").join(first, "o_custkey").select(F.col("o_orderkey").alias("task_id"), "repeat_of")


@query(
    "running_phase",
    """WITH s AS (SELECT feature_id, feature_id // 7 AS model, start_pos, end_pos, (feature_id % 3)::INT AS phase, CASE WHEN (feature_id // 7) % 2 = 0 THEN start_pos ELSE -start_pos END AS place FROM v_feature),
    b AS (SELECT *, sum(end_pos - start_pos) OVER w - (end_pos - start_pos) AS bases, first_value(phase) OVER w AS lead_in, row_number() OVER w AS rn FROM s WINDOW w AS (PARTITION BY model ORDER BY place, start_pos, end_pos, phase))
    SELECT model, start_pos, end_pos, (CASE WHEN rn = 1 THEN phase ELSE (3 - ((bases - lead_in) % 3 + 3) % 3) % 3 END)::INT AS expected FROM b""",
)
def running_phase(t: Tables) -> DataFrame:
    model = F.floor(F.col("feature_id") / 7)
    segment = F.struct(F.col("start_pos").alias("start"), F.col("end_pos").alias("end"), F.when(model % 2 == 0, 1).otherwise(-1).alias("strand"), (F.col("feature_id") % 3).cast("int").alias("phase"))
    m = t.v_feature.groupBy(model.alias("model")).agg(F.collect_list(segment).alias("s"))  # as many as a CDS has
    e = m.select("model", F.explode(Q.expected_phases(F.col("s"))).alias("e"))
    return e.select("model", F.col("e.start").alias("start_pos"), F.col("e.end").alias("end_pos"), "e.expected")


@query(
    "nearest_occurrence",
    """WITH p AS (SELECT doc_id, length(text) // 2 AS claimed, list_filter(range(1, length(text) + 1), lambda i: substr(text, i, 4) = ' the') AS places FROM documents)
    SELECT doc_id, list_min(list_transform(places, lambda i: abs(i - 1 - claimed))) AS distance FROM p WHERE len(places) > 0""",
)
def nearest_occurrence(t: Tables) -> DataFrame:
    # places as running lengths of what stands between them: one pass over a text of any length; " the" can't overlap itself
    d = t.documents.select("doc_id", F.floor(F.length("text") / 2).alias("claimed"), F.split("text", " the").alias("pieces"))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit(None).cast("long").alias("best"))

    def step(acc, piece):
        place = acc["at"] + F.length(piece)
        return F.struct((place + 4).alias("at"), F.least(acc["best"], F.abs(place - F.col("claimed"))).alias("best"))

    before = F.slice("pieces", 1, F.size("pieces") - 1)
    return d.where(F.size("pieces") > 1).select("doc_id", F.aggregate(before, zero, step)["best"].alias("distance"))
