"""Aggregation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.evidence import redundant
from quillon.registry import query
from quillon.sources.standins import Tables


@query("count_where", "SELECT count(*) AS n FROM v_measurement WHERE unit = 'F'")
def count_where(t: Tables) -> DataFrame:
    return t.v_measurement.where("unit = 'F'").agg(F.count("*").alias("n"))


@query("histogram", "SELECT coalesce(cast(quality AS VARCHAR), 'unrecorded') AS k, count(*) AS n FROM v_document GROUP BY 1")
def histogram(t: Tables) -> DataFrame:
    return t.v_document.groupBy(F.coalesce(F.col("quality").cast("string"), F.lit("unrecorded")).alias("k")).agg(F.count("*").alias("n"))


@query("histogram_distinct", "SELECT quantity_kind, count(DISTINCT sample_id) AS samples FROM v_measurement GROUP BY quantity_kind")
def histogram_distinct(t: Tables) -> DataFrame:
    return t.v_measurement.groupBy("quantity_kind").agg(F.count_distinct("sample_id").alias("samples"))


@query(
    "having_repeat",
    """SELECT * FROM (SELECT o_custkey, count(*) AS proposals, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS rejected FROM orders GROUP BY o_custkey) x
    WHERE proposals >= 2 AND rejected >= proposals / 2.0""",
)
def having_repeat(t: Tables) -> DataFrame:
    g = t.orders.groupBy("o_custkey").agg(F.count("*").alias("proposals"), F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("rejected"))
    return g.where((F.col("proposals") >= 2) & (F.col("rejected") >= F.col("proposals") / 2))


@query(
    "queue_stats",
    """SELECT count(*) AS total, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'in_progress' AND lease_expires_at < TIMESTAMP '1998-01-01') AS expired,
    count(*) FILTER (attempts >= 3) AS stalled, min(priority) AS first_priority, max(priority) AS last_priority FROM v_queue""",
)
def queue_stats(t: Tables) -> DataFrame:
    old = F.col("lease_expires_at") < F.lit("1998-01-01").cast("timestamp_ntz")
    return t.v_queue.agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "pending").alias("pending"), F.count_if((F.col("status") == "in_progress") & old).alias("expired"),
        F.count_if(F.col("attempts") >= 3).alias("stalled"), F.min("priority").alias("first_priority"), F.max("priority").alias("last_priority"),
    )


@query("group_concat", "SELECT n_regionkey, string_agg(n_name, '; ' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def group_concat(t: Tables) -> DataFrame:
    return t.nation.groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), "; ").alias("names"))


@query(
    "karyotype_bins",
    """WITH s AS (SELECT seqid, max(start_pos) // 10000 AS last FROM v_feature GROUP BY seqid), b AS (SELECT seqid, unnest(range(0, last + 1)) AS bin FROM s),
    c AS (SELECT seqid, start_pos // 10000 AS bin, count(*) AS n FROM v_feature WHERE biotype = 'click' GROUP BY 1, 2)
    SELECT b.seqid, b.bin, coalesce(c.n, 0) AS n FROM b LEFT JOIN c ON b.seqid = c.seqid AND b.bin = c.bin""",
)
def karyotype_bins(t: Tables) -> DataFrame:
    # the frame comes from all features, the counts from the filtered ones: empty bins and sequences stay
    width = 10_000
    f = t.v_feature.withColumn("bin", F.floor(F.col("start_pos") / width))
    frame = f.groupBy("seqid").agg(F.max("bin").alias("last")).select("seqid", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("bin"))
    counts = f.where("biotype = 'click'").groupBy("seqid", "bin").agg(F.count("*").alias("n"))
    return frame.join(counts, ["seqid", "bin"], "left").na.fill(0, ["n"])


@query(
    "facet_counts",
    """SELECT 'biotype' AS facet, biotype AS key, count(*) AS n FROM v_feature WHERE strand = 1 AND seqid = 5 GROUP BY biotype
    UNION ALL SELECT 'strand', cast(strand AS VARCHAR), count(*) FROM v_feature WHERE biotype = 'view' AND seqid = 5 GROUP BY strand
    UNION ALL SELECT 'seqid', cast(seqid AS VARCHAR), count(*) FROM v_feature WHERE biotype = 'view' AND strand = 1 GROUP BY seqid""",
)
def facet_counts(t: Tables) -> DataFrame:
    filters = {"biotype": "view", "strand": 1, "seqid": 5}
    # one pass: a row counts for a facet if all other facets' filters let it through
    passes = {f: F.col(f) == v for f, v in filters.items()}
    rows = []
    for f in filters:
        others = F.lit(True)
        for g in filters:
            others = others & passes[g] if g != f else others
        rows.append(F.when(others, F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("key"))))
    return t.v_feature.select(F.explode(F.array_compact(F.array(*rows))).alias("x")).groupBy("x.facet", "x.key").agg(F.count("*").alias("n"))


@query(
    "study_rollup",
    """SELECT experiment_id % 50 AS study, count(*) AS runs, count(sample_id) AS matched, count(*) FILTER (discount > 0.05) AS excluded,
    count(*) FILTER (quantity_kind = 'A') || '/' || count(*) FILTER (quantity_kind = 'N') || '/' || count(*) FILTER (quantity_kind = 'R') AS by_kind FROM v_measurement GROUP BY 1""",
)
def study_rollup(t: Tables) -> DataFrame:
    kinds = F.concat_ws("/", *(F.count_if(F.col("quantity_kind") == k).cast("string") for k in "ANR"))
    g = t.v_measurement.groupBy((F.col("experiment_id") % 50).alias("study"))
    return g.agg(F.count("*").alias("runs"), F.count("sample_id").alias("matched"), F.count_if(F.col("discount") > 0.05).alias("excluded"), kinds.alias("by_kind"))


@query(
    "corpus_funnel",
    """SELECT count(*) AS found, count(quality) AS screened, count(*) FILTER (quality = 1) AS included, count(*) FILTER (quality = 1 AND length(text) > 1000) AS readable,
    greatest(0, count(*) - count(quality)) AS unscreened, greatest(0, count(quality) - count(*) FILTER (quality = 1)) AS rejected FROM v_document""",
)
def corpus_funnel(t: Tables) -> DataFrame:
    good = F.col("quality") == 1
    n = t.v_document.agg(F.count("*").alias("found"), F.count("quality").alias("screened"), F.count_if(good).alias("included"), F.count_if(good & (F.length("text") > 1000)).alias("readable"))
    return n.withColumns({"unscreened": F.greatest(F.lit(0), F.col("found") - F.col("screened")), "rejected": F.greatest(F.lit(0), F.col("screened") - F.col("included"))})


@query("singleton_kinds", "SELECT count(*) AS singletons FROM (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) = 1) x")
def singleton_kinds(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") == 1).alias("singletons"))


@query(
    "vocab_drift",
    """SELECT quantity_kind || unit AS kind, quantity_kind || unit IN ('AF', 'NO') AS known, count(*) AS n, min(measurement_id) AS first_id, count(DISTINCT strain_id) AS strains FROM v_measurement GROUP BY 1, 2""",
)
def vocab_drift(t: Tables) -> DataFrame:
    vocab = t._spark.createDataFrame([("AF",), ("NO",)], "kind string").withColumn("known", F.lit(True))
    g = t.v_measurement.groupBy(F.concat("quantity_kind", "unit").alias("kind")).agg(F.count("*").alias("n"), F.min("measurement_id").alias("first_id"), F.count_distinct("strain_id").alias("strains"))
    return g.join(F.broadcast(vocab), "kind", "left").na.fill(False, ["known"])


@query("all_null_columns", "SELECT 'quality' AS axis, count(quality) = 0 AS unscored FROM v_document UNION ALL SELECT 'toxic', count(toxic) = 0 FROM v_document UNION ALL SELECT 'novelty', true")
def all_null_columns(t: Tables) -> DataFrame:
    d = t.v_document.withColumn("novelty", F.lit(None).cast("double"))
    axes = ["quality", "toxic", "novelty"]
    one = d.agg(*((F.count(c) == 0).alias(c) for c in axes))
    return one.unpivot([], axes, "axis", "unscored")


@query("ambiguous_keys", "SELECT p_type AS key, count(DISTINCT p_brand) AS anchors FROM part GROUP BY p_type HAVING count(DISTINCT p_brand) > 1")
def ambiguous_keys(t: Tables) -> DataFrame:
    return t.part.groupBy(F.col("p_type").alias("key")).agg(F.count_distinct("p_brand").alias("anchors")).where("anchors > 1")


@query(
    "redundancy_flags",
    """SELECT measurement_id, biosample, members, 'technical_replicate' AS kind, 'warn' AS severity FROM (SELECT measurement_id, experiment_id || '/' || strain_id AS biosample, count(*) OVER (PARTITION BY experiment_id, strain_id) AS members
      FROM v_measurement WHERE experiment_id IS NOT NULL AND strain_id IS NOT NULL) x WHERE members >= 2""",
)
def redundancy_flags(t: Tables) -> DataFrame:
    runs = t.v_measurement.where("experiment_id IS NOT NULL AND strain_id IS NOT NULL").select("measurement_id", F.concat_ws("/", "experiment_id", "strain_id").alias("biosample"))
    return redundant(runs, "biosample").select("measurement_id", "biosample", "members", F.lit("technical_replicate").alias("kind"), F.lit("warn").alias("severity"))


@query(
    "isolation_conflicts",
    "SELECT measurement_id, together FROM (SELECT measurement_id, line, count(*) OVER (PARTITION BY experiment_id) AS together FROM v_measurement) x WHERE line = 7 AND together > 1",
)
def isolation_conflicts(t: Tables) -> DataFrame:
    n = F.count("*").over(Window.partitionBy("experiment_id"))
    return t.v_measurement.withColumn("together", n).where("line = 7 AND together > 1").select("measurement_id", "together")


@query("pool_units", "SELECT gene, grp, sum(n) AS pooled FROM v_matrix GROUP BY gene, grp")
def pool_units(t: Tables) -> DataFrame:
    return t.v_matrix.groupBy("gene", "grp").agg(F.sum("n").alias("pooled"))


@query(
    "budget_status",
    """SELECT c.k AS criterion, c.cap, coalesce(n, 0) AS admitted, greatest(0, c.cap - coalesce(n, 0)) AS remaining, coalesce(n, 0) > c.cap AS overspent
    FROM (VALUES ('en', 500), ('de', 200), ('it', 5)) c(k, cap) LEFT JOIN (SELECT lang, count(*) AS n FROM documents GROUP BY lang) d ON d.lang = c.k""",
)
def budget_status(t: Tables) -> DataFrame:
    caps = t._spark.createDataFrame([("en", 500), ("de", 200), ("it", 5)], "criterion string, cap int")
    n = t.documents.groupBy(F.col("lang").alias("criterion")).agg(F.count("*").alias("admitted"))
    j = caps.join(n, "criterion", "left").na.fill(0, ["admitted"])
    return j.select("criterion", "cap", "admitted", F.greatest(F.lit(0), F.col("cap") - F.col("admitted")).alias("remaining"), (F.col("admitted") > F.col("cap")).alias("overspent"))


_VERDICT = "CASE WHEN value > 49.5 AND discount > 0.08 THEN 0 WHEN value > 45 THEN 1 WHEN value > 2 THEN 2 ELSE 3 END"


@query("verdict_rollup", f"SELECT experiment_id, CASE min({_VERDICT}) WHEN 0 THEN 'refused' WHEN 1 THEN 'flag' WHEN 2 THEN 'pass' ELSE 'not_evaluable' END AS verdict FROM v_measurement GROUP BY experiment_id")
def verdict_rollup(t: Tables) -> DataFrame:
    names = F.array(*(F.lit(x) for x in ("refused", "flag", "pass", "not_evaluable")))
    worst = t.v_measurement.groupBy("experiment_id").agg(F.min(F.expr(_VERDICT)).alias("w"))
    return worst.select("experiment_id", F.element_at(names, F.col("w") + 1).alias("verdict"))


@query("ratio_null_safe", "SELECT lang, round(count(*) FILTER (toxic = 1) / nullif(count(toxic), 0)::DOUBLE, 6) AS share FROM v_document GROUP BY lang")
def ratio_null_safe(t: Tables) -> DataFrame:
    share = F.try_divide(F.count_if(F.col("toxic") == 1), F.nullif(F.count("toxic"), F.lit(0)))
    return t.v_document.groupBy("lang").agg(F.round(share, 6).alias("share"))


@query("inventory", "SELECT (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM part) AS parts, (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM labels) AS labels")
def inventory(t: Tables) -> DataFrame:
    counts = None
    for name, df in (("orders", t.orders), ("parts", t.part), ("documents", t.documents), ("labels", t.labels)):
        one = df.agg(F.count("*").alias(name))
        counts = one if counts is None else counts.crossJoin(one)  # single rows
    return counts


@query("screen_report", "SELECT strain_id, count(DISTINCT experiment_id) AS runs, round(sum(price), 2) AS bases, count(*) FILTER (tax > discount) AS misranked FROM v_measurement GROUP BY strain_id")
def screen_report(t: Tables) -> DataFrame:
    return t.v_measurement.groupBy("strain_id").agg(F.count_distinct("experiment_id").alias("runs"), F.round(F.sum("price"), 2).alias("bases"), F.count_if(F.col("tax") > F.col("discount")).alias("misranked"))


@query(
    "zero_seeded_counts",
    "SELECT k.kind, coalesce(n, 0) AS n FROM (VALUES ('pending'), ('accepted'), ('rejected'), ('in_progress')) k(kind) LEFT JOIN (SELECT status, count(*) AS n FROM v_queue GROUP BY status) q ON q.status = k.kind",
)
def zero_seeded_counts(t: Tables) -> DataFrame:
    kinds = t._spark.createDataFrame([("pending",), ("accepted",), ("rejected",), ("in_progress",)], "kind string")
    return kinds.join(t.v_queue.groupBy(F.col("status").alias("kind")).agg(F.count("*").alias("n")), "kind", "left").na.fill(0, ["n"])


# ---------------------------------------------------------------- matrices


@query("matrix_long", "SELECT gene, sample, n FROM v_matrix")
def matrix_long(t: Tables) -> DataFrame:
    # the wide form, as files have it, back to the long form
    wide = t.v_matrix.groupBy("gene").pivot("sample", [0, 1, 2, 3, 4, 5]).agg(F.sum("n"))
    long = wide.unpivot(["gene"], ["0", "1", "2", "3", "4", "5"], "sample", "n").where("n IS NOT NULL")
    return long.select("gene", F.col("sample").cast("int").alias("sample"), "n")


@query("matrix_cpm", "SELECT m.gene, m.sample, round(m.n * 1e6 / s.total, 6) AS cpm FROM v_matrix m JOIN (SELECT sample, sum(n) AS total FROM v_matrix GROUP BY sample) s ON m.sample = s.sample")
def matrix_cpm(t: Tables, wanted: list[int] | None = None) -> DataFrame:
    # the query wants all genes; a list keeps only its own
    total = t.v_matrix.groupBy("sample").agg(F.sum("n").alias("total"))  # over all genes, also those not wanted
    m = t.v_matrix if wanted is None else t.v_matrix.where(F.col("gene").isin(wanted))
    return m.join(F.broadcast(total), "sample").select("gene", "sample", F.round(F.col("n") * 1e6 / F.col("total"), 6).alias("cpm"))


@query("matrix_samples", "SELECT DISTINCT sample, grp FROM v_matrix")
def matrix_samples(t: Tables) -> DataFrame:
    return t.v_matrix.select("sample", "grp").distinct()


@query("matrix_pivot", "SELECT gene, " + ", ".join(f"coalesce(sum(n) FILTER (sample = {i}), 0) AS s{i}" for i in range(6)) + " FROM v_matrix GROUP BY gene")
def matrix_pivot(t: Tables) -> DataFrame:
    wide = t.v_matrix.groupBy("gene").pivot("sample", list(range(6))).agg(F.sum("n")).na.fill(0)
    return wide.select("gene", *(F.col(str(i)).alias(f"s{i}") for i in range(6)))
