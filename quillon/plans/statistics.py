"""Statistical queries over the stand-in matrix and contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators import statistics as S
from quillon.operators.relational import keys_unlike
from quillon.registry import query
from quillon.sources.standins import Tables

_FACTORS = """
    k AS (SELECT count(DISTINCT sample) AS k FROM v_matrix),
    g AS (SELECT gene, avg(ln(n)) AS m FROM v_matrix WHERE n > 0 GROUP BY gene HAVING count(*) = (SELECT k FROM k)),
    f AS (SELECT sample, exp(median(ln(n) - m)) AS factor FROM v_matrix JOIN g ON v_matrix.gene = g.gene GROUP BY sample)"""


@query("size_factors", f"WITH {_FACTORS} SELECT sample, round(factor, 6) AS factor FROM f")
def size_factors(t: Tables) -> DataFrame:
    return S.size_factors(t.v_matrix, "gene", "sample", "n").select("sample", F.round("factor", 6).alias("factor"))


_MEANS = f"""WITH {_FACTORS},
    a AS (SELECT DISTINCT gene FROM v_matrix), b AS (SELECT DISTINCT sample, grp FROM v_matrix),
    x AS (SELECT a.gene, b.grp, coalesce(v.n, 0) / f.factor AS x, log2(coalesce(v.n, 0) / f.factor + 1) AS y FROM a CROSS JOIN b JOIN f USING (sample) LEFT JOIN v_matrix v ON v.gene = a.gene AND v.sample = b.sample),
    m AS (SELECT gene, avg(x) FILTER (grp = 'ref') AS ref, avg(x) FILTER (grp = 'trt') AS trt, avg(x) AS base, count(*) FILTER (grp = 'ref') AS n_ref, count(*) FILTER (grp = 'trt') AS n_trt,
      avg(y) FILTER (grp = 'trt') - avg(y) FILTER (grp = 'ref') AS diff, var_samp(y) FILTER (grp = 'ref') AS v_ref, var_samp(y) FILTER (grp = 'trt') AS v_trt,
      greatest(avg(x) FILTER (grp = 'ref'), avg(x) FILTER (grp = 'trt')) >= 10 AS eligible FROM x GROUP BY gene)"""


def _means(t: Tables) -> DataFrame:
    return S.contrast_moments(t.v_matrix, "gene", "sample", "grp", "n", "ref", "trt")


@query("log2fc", f"{_MEANS} SELECT gene, round(log2(trt + 1) - log2(ref + 1), 6) AS lfc, round(base, 6) AS base_mean, eligible FROM m")
def log2fc(t: Tables) -> DataFrame:
    return _means(t).select("gene", F.round("log2_fold_change", 6).alias("lfc"), F.round("base_mean", 6).alias("base_mean"), "eligible")


@query("underpowered", f"{_MEANS} SELECT gene, n_ref, n_trt, n_ref < 2 OR n_trt < 2 AS underpowered FROM m")
def underpowered(t: Tables) -> DataFrame:
    return _means(t).select("gene", "n_ref", "n_trt", "underpowered")


_SE = "(v_ref / n_ref + v_trt / n_trt)"


@query(
    "welch_t",
    f"""{_MEANS} SELECT gene, CASE WHEN eligible AND {_SE} > 1e-18 THEN round(diff / sqrt{_SE}, 5) END AS t,
      CASE WHEN eligible AND {_SE} > 1e-18 THEN round(pow{_SE.replace(')', ', 2)')} / (pow(v_ref / n_ref, 2) / (n_ref - 1) + pow(v_trt / n_trt, 2) / (n_trt - 1)), 5) END AS df FROM m""",
)
def welch_t(t: Tables) -> DataFrame:
    return S.welch(_means(t)).select("gene", F.round("t", 5).alias("t"), F.round("df", 5).alias("df"))


@query("welch_p")
def welch_p(t: Tables) -> DataFrame:
    return S.differential_expression(_means(t), "gene", method="welch_t").select("gene", "t", "df", "p", "q", "tested")


_S2 = "((n_ref - 1) * v_ref + (n_trt - 1) * v_trt) / (n_ref + n_trt - 2)"


@query("variance_prior_moments", f"{_MEANS} SELECT round(avg(ln(s2)), 6) AS mean_log, round(var_samp(ln(s2)), 6) AS var_log, count(*) AS genes FROM (SELECT {_S2} AS s2 FROM m WHERE eligible) y WHERE s2 > 1e-18")
def variance_prior_moments(t: Tables) -> DataFrame:
    return S.prior_moments(_means(t)).select(F.round("mean_log", 6).alias("mean_log"), F.round("var_log", 6).alias("var_log"), "genes")


@query("moderated_t")
def moderated_t(t: Tables) -> DataFrame:
    return S.differential_expression(_means(t), "gene").drop("mean_ref", "mean_trt")


@query("bonferroni", "SELECT id, round(least(1.0, p * count(*) OVER ())::DOUBLE, 8) AS p_adjusted FROM (SELECT p_partkey AS id, ((p_partkey * 7919) % 10007 + 1) / 100080000.0 AS p FROM part) x")
def bonferroni(t: Tables) -> DataFrame:
    p = t.part.select(F.col("p_partkey").alias("id"), (((F.col("p_partkey") * 7919) % 10007 + 1) / F.lit(100080000.0)).alias("p"))
    n = p.agg(F.count("*").alias("tests"))  # a single row
    return p.crossJoin(F.broadcast(n)).select("id", F.round(F.least(F.lit(1.0), F.col("p") * F.col("tests")), 8).alias("p_adjusted"))


_RHO = """WITH p AS (SELECT a.sample AS a, b.sample AS b, a.n AS x, b.n AS y FROM v_matrix a JOIN v_matrix b ON a.gene = b.gene AND a.sample <> b.sample),
    r AS (SELECT a, b, row_number() OVER (PARTITION BY a, b ORDER BY x) AS i, row_number() OVER (PARTITION BY a, b ORDER BY y) AS j, x, y FROM p),
    k AS (SELECT a, b, avg(i) OVER (PARTITION BY a, b, x) AS rx, avg(j) OVER (PARTITION BY a, b, y) AS ry FROM r),
    rho AS (SELECT a, b, corr(rx, ry) AS rho FROM k GROUP BY a, b)"""


@query("spearman", f"{_RHO} SELECT a, b, round(rho, 6) AS rho FROM rho")
def spearman(t: Tables) -> DataFrame:
    return S.spearman_pairs(t.v_matrix, "gene", "sample", "n").select("a", "b", F.round("rho", 6).alias("rho"))


@query("cohesion", f"{_RHO} SELECT a AS sample, round(max(rho), 6) AS cohesion FROM rho WHERE (a < 3) = (b < 3) GROUP BY a")
def cohesion(t: Tables) -> DataFrame:
    rho = S.spearman_pairs(t.v_matrix, "gene", "sample", "n").where("(a < 3) = (b < 3)")
    return rho.groupBy(F.col("a").alias("sample")).agg(F.round(F.max("rho"), 6).alias("cohesion"))


_CELLS = "(SELECT DISTINCT 'all' AS study, sample, sample // 4 AS context, sample // 2 % 2 AS strain FROM v_matrix)"


@query(
    "coherence_flags",
    f"""{_RHO}, s AS {_CELLS}, q AS (SELECT r.a, r.b, r.rho, x.context = y.context AND x.strain = y.strain AS own, x.context = y.context AS near FROM rho r JOIN s x ON x.sample = r.a JOIN s y ON y.sample = r.b),
    m AS (SELECT a AS sample, max(rho) FILTER (own) - max(rho) FILTER (NOT own) AS margin, arg_min(b, (-round(rho, 12), b)) FILTER (NOT own) AS resembles, arg_min(near, (-round(rho, 12), b)) FILTER (NOT own) AS near FROM q GROUP BY a),
    d AS (SELECT median(margin) AS med FROM m), e AS (SELECT 1.4826 * median(abs(margin - med)) AS mad FROM m, d),
    z AS (SELECT *, CASE WHEN mad = 0 THEN 0 ELSE (margin - med) / mad END AS z, count(*) OVER () AS n FROM m, d, e WHERE margin IS NOT NULL)
    SELECT sample, round(margin, 6) AS margin, round(z, 4) AS z, resembles, n >= 4 AND z < -3 AS quarantined, CASE WHEN n >= 4 AND z < -3 THEN CASE WHEN near THEN 'genotype' ELSE 'condition' END END AS fault FROM z""",
)
def coherence_flags(t: Tables) -> DataFrame:
    samples = t.v_matrix.select("sample").distinct().select(F.lit("all").alias("study"), "sample", F.expr("sample div 4").alias("context"), F.expr("sample div 2 % 2").alias("strain"))
    out = S.coherence(S.spearman_pairs(t.v_matrix, "gene", "sample", "n"), samples)
    return out.select("sample", F.round("margin", 6).alias("margin"), F.round("z", 4).alias("z"), "resembles", "quarantined", "fault")


_DECLARED = "(SELECT DISTINCT m.sample, m.gene FROM v_matrix m JOIN v_product p ON p.product_id = m.gene WHERE p.carbons >= 40 AND m.grp = 'trt')"


@query(
    "marker_flags",
    f"""WITH d AS {_DECLARED}, c AS (SELECT g.gene, s.sample, coalesce(m.n, 0) AS n FROM (SELECT DISTINCT gene FROM d) g CROSS JOIN (SELECT DISTINCT sample FROM v_matrix) s LEFT JOIN v_matrix m ON m.gene = g.gene AND m.sample = s.sample),
    o AS (SELECT *, lead(n) OVER (PARTITION BY gene ORDER BY n, sample) AS top FROM c), e AS (SELECT gene, max((top - n, n, top)) AS b FROM o WHERE n > 0 AND top IS NOT NULL GROUP BY gene),
    f AS (SELECT c.gene, c.sample, d.gene IS NOT NULL AS declared_high, c.n > b[2] AS observed_high FROM c JOIN e ON e.gene = c.gene AND b[3] >= 4 * b[2] LEFT JOIN d ON d.gene = c.gene AND d.sample = c.sample)
    SELECT * FROM f WHERE declared_high <> observed_high""",
)
def marker_flags(t: Tables) -> DataFrame:
    carried = t.v_product.where("carbons >= 40").select(F.col("product_id").alias("gene"))
    declared = t.v_matrix.where("grp = 'trt'").join(carried, "gene").select("sample", "gene").distinct()
    return S.marker_flags(t.v_matrix, declared, "gene", "sample", "n")


@query("quarantine_exclude", "SELECT measurement_id, strain_id FROM v_measurement WHERE strain_id NOT IN (SELECT target_id FROM v_flag WHERE status IN ('active', 'confirmed'))")
def quarantine_exclude(t: Tables) -> DataFrame:
    held = t.v_flag.where("status IN ('active', 'confirmed')").select(F.col("target_id").alias("strain_id"))
    return t.v_measurement.join(held, "strain_id", "left_anti").select("measurement_id", "strain_id")


_FIRST = "array_to_string([coalesce(CAST(x.id AS VARCHAR), '?') for x in list_slice(list_sort({}), 1, 4)], ', ')"
_REFUSALS = [
    ("empty_side", "sides < 2", ""),
    ("repeated_sample", "samples <> named", ""),
    ("not_in_atlas", "len(missing) > 0", f"concat(len(missing), ': ', {_FIRST.format('missing')})"),
    ("quarantined", "len(held) > 0", "array_to_string([concat(x.id, ' ', left(x.rationale, 220)) for x in list_sort(held)], ', ')"),
    ("no_context", "len(bare) > 0", f"concat(len(bare), ' of ', members, ': ', {_FIRST.format('bare')})"),
    ("group_without_context", "reference_context IS NULL OR treatment_context IS NULL", "concat_ws(', ', CASE WHEN reference_context IS NULL THEN 'reference' END, CASE WHEN treatment_context IS NULL THEN 'treatment' END)"),
    ("genotype_across_contexts", "genotype AND NOT same", "concat(coalesce(CAST(reference_context AS VARCHAR), '?'), ' and ', coalesce(CAST(treatment_context AS VARCHAR), '?'))"),
    ("no_strain", "genotype AND (strains IS NULL OR others IS NULL)", "concat_ws(', ', CASE WHEN strains IS NULL THEN 'reference' END, CASE WHEN others IS NULL THEN 'treatment' END)"),
    ("same_strain", "genotype AND strains = others", ""),
    ("no_axis", "same AND NOT genotype", "reference_context"),
    ("several_studies", "len(studies) > 1", "array_to_string(studies, ', ')"),
    ("several_organisms", "len(organisms) > 1", "array_to_string(organisms, ', ')"),
]
_DETAILS = ", ".join(f"CASE WHEN {c} THEN concat('{k} ', {d}) END" for k, c, d in _REFUSALS if d)


@query(
    "contrast_refusals",
    f"""WITH q AS (SELECT target_id, min(concat(status, ' below ', CAST(ceil(statistic) AS BIGINT))) AS rationale FROM v_flag WHERE severity = 'quarantine' AND status IN ('active', 'confirmed') GROUP BY target_id),
    s AS (SELECT sample_id, max(context_id) AS context_id, max(strain_id) AS strain_id FROM v_sample GROUP BY sample_id), r AS (SELECT sample_id, max(study) AS study, max(organism) AS organism FROM v_run GROUP BY sample_id),
    m AS (SELECT c.*, {{'side': c.side, 'line': c.line, 'id': c.sample_id}} AS place, s.sample_id IS NOT NULL AS known, s.context_id, s.strain_id, q.rationale, r.study, r.organism
      FROM v_contrast_member c LEFT JOIN s ON s.sample_id = c.sample_id LEFT JOIN q ON q.target_id = c.sample_id LEFT JOIN r ON r.sample_id = c.sample_id),
    g AS (SELECT experiment_id, reference_context, treatment_context, coalesce(axis = 'genotype', false) AS genotype, coalesce(reference_context = treatment_context, false) AS same, count(*) AS members,
      count(DISTINCT side) FILTER (side IN ('reference', 'treatment')) AS sides, count(sample_id) AS samples, count(DISTINCT sample_id) AS named,
      list(place) FILTER (NOT known) AS missing, list(DISTINCT {{'id': sample_id, 'rationale': rationale}}) FILTER (rationale IS NOT NULL) AS held, list(place) FILTER (known AND context_id IS NULL) AS bare,
      list_sort(list(DISTINCT strain_id) FILTER (side = 'reference' AND strain_id IS NOT NULL)) AS strains, list_sort(list(DISTINCT strain_id) FILTER (side = 'treatment' AND strain_id IS NOT NULL)) AS others,
      list_sort(list(DISTINCT study) FILTER (study IS NOT NULL)) AS studies, list_sort(list(DISTINCT organism) FILTER (organism IS NOT NULL)) AS organisms FROM m GROUP BY experiment_id, axis, reference_context, treatment_context)
    SELECT experiment_id, concat_ws(',', {", ".join(f"CASE WHEN {c} THEN '{k}' END" for k, c, _ in _REFUSALS)}) AS reasons, concat_ws('; ', {_DETAILS}) AS details FROM g""",
)
def contrast_refusals(t: Tables) -> DataFrame:
    flags = t.v_flag.withColumn("rationale", F.concat("status", F.lit(" below "), F.ceil("statistic").cast("string")))
    return S.refusals(t.v_contrast_member, t.v_sample, flags, t.v_run, "experiment_id").select("experiment_id", "reasons", "details")


@query("contrast_pairs", "SELECT a.context_id AS a, b.context_id AS b FROM v_context a JOIN v_context b ON a.aeration = b.aeration AND a.temperature_c = b.temperature_c AND a.context_id < b.context_id AND a.feedstock <> b.feedstock")
def contrast_pairs(t: Tables) -> DataFrame:
    c = t.v_context.select("aeration", "temperature_c", "context_id", "feedstock")
    return keys_unlike(c, ["aeration", "temperature_c"], "context_id", "feedstock").select("a", "b")


@query("power_table", "SELECT n, sigma, round(2.8015852182 * sigma * sqrt(2.0 / n), 6) AS detectable, ceil(2 * pow(2.8015852182 * sigma, 2))::BIGINT AS needed FROM (VALUES (3, 0.2), (4, 0.5), (10, 0.9)) v(n, sigma)")
def power_table(t: Tables) -> DataFrame:
    v = t._spark.createDataFrame([(3, 0.2), (4, 0.5), (10, 0.9)], "n int, sigma double")
    return v.select("n", "sigma", F.round(S.min_detectable(F.col("sigma"), F.col("n")), 6).alias("detectable"), S.required_n(F.col("sigma"), F.lit(1.0)).alias("needed"))


@query("sign_test", "SELECT n, round(2 * pow(0.5, n), 12) AS p, n >= 6 AS enough FROM (SELECT unnest(range(1, 11)) AS n) x")
def sign_test(t: Tables) -> DataFrame:
    return t._spark.range(1, 11).select(F.col("id").alias("n"), F.round(2 * F.pow(F.lit(0.5), "id"), 12).alias("p"), (F.col("id") >= 6).alias("enough"))


@query(
    "study_dispersion",
    """WITH g AS (SELECT grp, gene, stddev_samp(log2(n + 1)) AS sd FROM v_matrix GROUP BY grp, gene HAVING median(n) >= 10 AND count(*) > 1) SELECT grp, round(median(sd), 6) AS dispersion, count(*) AS genes FROM g GROUP BY grp""",
)
def study_dispersion(t: Tables) -> DataFrame:
    g = t.v_matrix.groupBy("grp", "gene").agg(F.stddev_samp(F.log2(F.col("n") + 1)).alias("sd"), F.median("n").alias("med"), F.count("*").alias("k")).where("med >= 10 AND k > 1")
    return g.groupBy("grp").agg(F.round(F.median("sd"), 6).alias("dispersion"), F.count("*").alias("genes"))


@query(
    "closest_pair_sd",
    """WITH d AS (SELECT a.sample AS a, b.sample AS b, ln(a.n / b.n) AS d FROM v_matrix a JOIN v_matrix b ON a.gene = b.gene AND a.sample < b.sample AND a.grp = b.grp WHERE a.n > 0 AND b.n > 0),
    m AS (SELECT a, b, median(d) AS med FROM d GROUP BY a, b), s AS (SELECT d.a, d.b, 1.4826 * median(abs(d - med)) / sqrt(2) AS sd FROM d JOIN m ON d.a = m.a AND d.b = m.b GROUP BY d.a, d.b)
    SELECT round(min(sd), 6) AS sd FROM s""",
)
def closest_pair_sd(t: Tables) -> DataFrame:
    m = t.v_matrix.where("n > 0")
    b = m.select("gene", "grp", F.col("sample").alias("b"), F.col("n").alias("y"))
    d = m.join(b, ["gene", "grp"]).where("sample < b").select(F.col("sample").alias("a"), "b", F.log(F.col("n") / F.col("y")).alias("d"))
    med = d.groupBy("a", "b").agg(F.median("d").alias("med"))
    sd = d.join(med, ["a", "b"]).groupBy("a", "b").agg((1.4826 * F.median(F.abs(F.col("d") - F.col("med"))) / F.sqrt(F.lit(2.0))).alias("sd"))
    return sd.agg(F.round(F.min("sd"), 6).alias("sd"))


@query("baseline_profile", "SELECT gene, round(count(*) / 6.0, 6)::DOUBLE AS detection, min(n) AS low, median(n) AS mid, max(n) AS high, CASE WHEN min(n) > 0 THEN round(max(n) / min(n), 6) END AS fold FROM v_matrix GROUP BY gene")
def baseline_profile(t: Tables) -> DataFrame:
    fold = F.when(F.min("n") > 0, F.round(F.try_divide(F.max("n"), F.min("n")), 6))
    return t.v_matrix.groupBy("gene").agg(F.round(F.count("*") / 6.0, 6).alias("detection"), F.min("n").alias("low"), F.median("n").alias("mid"), F.max("n").alias("high"), fold.alias("fold"))


@query("library_split", "SELECT CASE WHEN sample % 3 = 0 THEN 'total' ELSE 'depleted' END AS library, count(DISTINCT sample) AS samples, sum(n) AS reads FROM v_matrix GROUP BY 1")
def library_split(t: Tables) -> DataFrame:
    selection = F.when(F.col("sample") % 3 == 0, "total").when(F.col("sample") % 3 == 1, "poly_a")  # unknown counts as depleted
    kind = F.when(selection == "total", "total").otherwise("depleted")
    return t.v_matrix.groupBy(kind.alias("library")).agg(F.count_distinct("sample").alias("samples"), F.sum("n").alias("reads"))


@query("gene_profile", "SELECT gene, string_agg(sample || '=' || n, ';' ORDER BY sample) AS profile FROM v_matrix GROUP BY gene")
def gene_profile(t: Tables) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("sample", "n")))  # as many as there are samples
    return t.v_matrix.groupBy("gene").agg(F.array_join(F.transform(rows, lambda x: F.concat_ws("=", x["sample"].cast("string"), x["n"].cast("string"))), ";").alias("profile"))


@query(
    "library_limits",
    """WITH m AS (SELECT *, sample % 2 AS study FROM v_matrix), p AS (SELECT a.study, a.sample AS a, b.sample AS b, log2(a.n + 1) - log2(b.n + 1) AS r FROM m a JOIN m b ON a.study = b.study AND a.gene = b.gene AND a.sample < b.sample AND a.n >= 1 AND b.n >= 1),
    d AS (SELECT study, a, b, r, median(r) OVER (PARTITION BY study, a, b) AS mid FROM p), s AS (SELECT study, a, b, 1.4826 * median(abs(r - mid)) / sqrt(2) AS sd FROM d GROUP BY study, a, b), c AS (SELECT study, min(sd) AS sd FROM s GROUP BY study)
    SELECT m.study, count(DISTINCT sample) AS samples, count(DISTINCT gene) AS genes, round(any_value(c.sd), 6) AS sd_closest, round(2.801585219 * any_value(c.sd) * sqrt(2.0 / 3), 6) AS detectable FROM m LEFT JOIN c ON c.study = m.study GROUP BY m.study""",
)
def library_limits(t: Tables) -> DataFrame:
    m = t.v_matrix.withColumn("study", F.col("sample") % 2)
    r = S.library_limits(m, "gene", "sample", "n", "study")
    return r.select("study", "samples", "genes", F.round("sd_closest", 6).alias("sd_closest"), F.round("detectable_log2fc", 6).alias("detectable"))
