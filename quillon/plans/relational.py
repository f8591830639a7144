"""Queries of the relational core: projections, filters, joins, sorting, paging, sets, upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators import relational as R
from quillon.registry import query
from quillon.sources.standins import Tables

# ---------------------------------------------------------------- scans and projections


@query("base_scan", "SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def base_scan(t: Tables) -> DataFrame:
    return t.supplier.alias("s").select("s.s_suppkey", "s.s_name", "s.s_nationkey")


@query("proj_alias", "SELECT product_id AS id, name AS display, tier FROM v_product")
def proj_alias(t: Tables) -> DataFrame:
    return t.v_product.select(F.col("product_id").alias("id"), F.col("name").alias("display"), "tier")


@query(
    "agg_all",
    """SELECT count(*) AS n, round(sum(value), 4) AS total, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean,
       count(DISTINCT strain_id) AS strains, string_agg(DISTINCT quantity_kind, ',' ORDER BY quantity_kind) AS kinds FROM v_measurement""",
)
def agg_all(t: Tables) -> DataFrame:
    m = t.v_measurement
    kinds = F.array_join(F.array_sort(F.collect_set("quantity_kind")), ",")
    return m.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.min("value").alias("low"), F.max("value").alias("high"), F.round(F.avg("value"), 6).alias("mean"), F.count_distinct("strain_id").alias("strains"), kinds.alias("kinds"))


@query("proj_diff", "SELECT feature_id, end_pos - start_pos AS span FROM v_feature")
def proj_diff(t: Tables) -> DataFrame:
    return t.v_feature.select("feature_id", (F.col("end_pos") - F.col("start_pos")).alias("span"))


@query("proj_coalesce", "SELECT measurement_id, coalesce(sample_id, experiment_id, strain_id) AS shown FROM v_measurement")
def proj_coalesce(t: Tables) -> DataFrame:
    return t.v_measurement.select("measurement_id", F.coalesce("sample_id", "experiment_id", "strain_id").alias("shown"))


@query("distinct_select", "SELECT DISTINCT tier, carbons FROM v_product")
def distinct_select(t: Tables) -> DataFrame:
    return t.v_product.select("tier", "carbons").distinct()


@query("adaptive_cols", "SELECT context_id, feedstock, 'humidity,pressure' AS missing FROM v_context")
def adaptive_cols(t: Tables) -> DataFrame:
    df, missing = R.adaptive(t.v_context, ["context_id", "feedstock", "humidity", "pressure"])
    return df.withColumn("missing", F.lit(",".join(missing)))


# ---------------------------------------------------------------- filters


@query("filter_and", "SELECT measurement_id, value FROM v_measurement WHERE value >= 45 AND quantity_kind = 'R' AND discount < 0.03")
def filter_and(t: Tables) -> DataFrame:
    return t.v_measurement.where((F.col("value") >= 45) & (F.col("quantity_kind") == "R") & (F.col("discount") < 0.03)).select("measurement_id", "value")


@query("filter_in_empty", "SELECT 'empty' AS kind, count(*) AS n FROM v_measurement WHERE 0 = 1 UNION ALL SELECT 'two', count(*) FROM v_measurement WHERE quantity_kind IN ('A', 'R')")
def filter_in_empty(t: Tables) -> DataFrame:
    one = lambda name, values: t.v_measurement.where(R.in_values("quantity_kind", values)).agg(F.lit(name).alias("kind"), F.count("*").alias("n"))
    return one("empty", []).union(one("two", ["A", "R"]))


@query("filter_null", "SELECT count(*) FILTER (sample_id IS NULL) AS without, count(*) FILTER (sample_id IS NOT NULL) AS having_one FROM v_measurement")
def filter_null(t: Tables) -> DataFrame:
    return t.v_measurement.agg(F.count_if(F.col("sample_id").isNull()).alias("without"), F.count_if(F.col("sample_id").isNotNull()).alias("having_one"))


@query("filter_ilike_or", "SELECT product_id, name FROM v_product WHERE name ILIKE '%RED%' OR family ILIKE '%RED%'")
def filter_ilike_or(t: Tables) -> DataFrame:
    return t.v_product.where(R.contains_any("RED", "name", "family")).select("product_id", "name")


@query("resolve_identifier", "SELECT strain_id, canonical_name FROM v_strain WHERE upper(canonical_name) = upper('supplier#000000007') OR cast(strain_id AS VARCHAR) = '7'")
def resolve_identifier(t: Tables) -> DataFrame:
    s = t.v_strain
    return s.where((F.upper("canonical_name") == F.upper(F.lit("supplier#000000007"))) | (F.col("strain_id").cast("string") == "7")).select("strain_id", "canonical_name")


@query("range_between", "SELECT feature_id, seqid, start_pos FROM v_feature WHERE start_pos BETWEEN 40000 AND 60000 AND seqid = 3")
def range_between(t: Tables) -> DataFrame:
    return t.v_feature.where(F.col("start_pos").between(40000, 60000) & (F.col("seqid") == 3)).select("feature_id", "seqid", "start_pos")


@query("semi_exists", "SELECT product_id FROM v_product p WHERE EXISTS (SELECT 1 FROM v_measurement m WHERE m.product_id = p.product_id AND m.value > 49)")
def semi_exists(t: Tables) -> DataFrame:
    return t.v_product.join(t.v_measurement.where("value > 49"), "product_id", "left_semi").select("product_id")


@query("enum_fold", "SELECT feature_id, CASE WHEN word IN ('+', 'plus', 'forward') THEN 1 WHEN word IN ('-', 'minus', 'reverse') THEN -1 END AS folded FROM (SELECT feature_id, CASE feature_id % 4 WHEN 0 THEN '+' WHEN 1 THEN 'minus' WHEN 2 THEN 'forward' ELSE 'both' END AS word FROM v_feature)")
def enum_fold(t: Tables) -> DataFrame:
    fold = F.create_map(*(F.lit(x) for k, v in (("+", 1), ("plus", 1), ("forward", 1), ("-", -1), ("minus", -1), ("reverse", -1)) for x in (k, v)))
    word = F.element_at(F.array(F.lit("+"), F.lit("minus"), F.lit("forward"), F.lit("both")), (F.col("feature_id") % 4 + 1).cast("int"))
    return t.v_feature.select("feature_id", F.try_element_at(fold, word).alias("folded"))


# ---------------------------------------------------------------- joins


@query("join_inner", "SELECT m.measurement_id, p.name, s.canonical_name FROM v_measurement m JOIN v_product p ON m.product_id = p.product_id JOIN v_strain s ON m.strain_id = s.strain_id WHERE m.value > 48")
def join_inner(t: Tables) -> DataFrame:
    return t.v_measurement.where("value > 48").join(t.v_product, "product_id").join(t.v_strain, "strain_id").select("measurement_id", "name", "canonical_name")


@query("join_left", "SELECT s.strain_id, f.status FROM v_strain s LEFT JOIN v_flag f ON s.strain_id = f.target_id AND f.status = 'active'")
def join_left(t: Tables) -> DataFrame:
    f = t.v_flag.where("status = 'active'")
    return t.v_strain.join(f, F.col("strain_id") == F.col("target_id"), "left").select("strain_id", "status")


@query("join_cross", "SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n")
def join_cross(t: Tables) -> DataFrame:
    return t.region.crossJoin(t.nation).select("r_name", "n_name")  # both are fixed vocabularies of a few rows


@query("left_join_count", "SELECT p.product_id, p.name, count(m.measurement_id) AS n FROM v_product p LEFT JOIN v_measurement m ON m.product_id = p.product_id AND m.value > 45 GROUP BY p.product_id, p.name")
def left_join_count(t: Tables) -> DataFrame:
    n = t.v_measurement.where("value > 45").groupBy("product_id").agg(F.count("*").alias("n"))  # summed before the join
    return t.v_product.join(n, "product_id", "left").select("product_id", "name", F.coalesce("n", F.lit(0)).alias("n"))


@query("semi_pool", "SELECT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)")
def semi_pool(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").join(t.labels.where("quality = 1"), "doc_id", "left_semi")


@query("anti_pool", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_pool(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left_anti")


@query("left_not_rejected", "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality IS NULL OR l.quality <> 0")
def left_not_rejected(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left").where(F.col("quality").isNull() | (F.col("quality") != 0)).select("doc_id")


@query("funnel_included_readable", "SELECT count(DISTINCT o.o_custkey) AS customers FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey WHERE o.o_orderstatus = 'F' AND l.l_quantity > 40")
def funnel_included_readable(t: Tables) -> DataFrame:
    big = t.lineitem.where("l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey"))
    return t.orders.where("o_orderstatus = 'F'").join(big, "o_orderkey", "left_semi").agg(F.count_distinct("o_custkey").alias("customers"))


_LINEAGE = "SELECT DISTINCT l_suppkey AS parent, l_partkey % 100 + 1 AS child FROM lineitem WHERE l_suppkey <> l_partkey % 100 + 1"


@query(
    "lineage_one_hop",
    f"""WITH e AS ({_LINEAGE})
    SELECT s.strain_id, coalesce(c.n, 0) AS children, coalesce(p.n, 0) AS parents FROM v_strain s
    LEFT JOIN (SELECT parent, count(*) AS n FROM e GROUP BY parent) c ON c.parent = s.strain_id
    LEFT JOIN (SELECT child, count(*) AS n FROM e GROUP BY child) p ON p.child = s.strain_id""",
)
def lineage_one_hop(t: Tables) -> DataFrame:
    li = t.lineitem.where(F.col("l_suppkey") != F.col("l_partkey") % 100 + 1)
    e = li.select(F.col("l_suppkey").alias("parent"), (F.col("l_partkey") % 100 + 1).alias("child")).distinct()
    children = e.groupBy(F.col("parent").alias("strain_id")).agg(F.count("*").alias("children"))
    parents = e.groupBy(F.col("child").alias("strain_id")).agg(F.count("*").alias("parents"))
    return t.v_strain.select("strain_id").join(children, "strain_id", "left").join(parents, "strain_id", "left").na.fill(0, ["children", "parents"])


@query("concat_key_join", "SELECT s.strain_id, f.status FROM v_strain s JOIN v_flag f ON 'S:' || f.target_id = 'S:' || s.strain_id")
def concat_key_join(t: Tables) -> DataFrame:
    key = lambda c: F.concat(F.lit("S:"), F.col(c).cast("string"))
    return t.v_strain.withColumn("k", key("strain_id")).join(t.v_flag.withColumn("k", key("target_id")), "k").select("strain_id", "status")


_REFS = "SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN 'strain' WHEN 1 THEN 'product' ELSE 'nation' END AS kind, event_id % 130 AS target FROM events"


@query(
    "polymorphic_dangling",
    f"""WITH r AS ({_REFS}), g AS (SELECT 'strain' AS kind, strain_id AS target FROM v_strain UNION ALL SELECT 'product', product_id FROM v_product UNION ALL SELECT 'nation', n_nationkey FROM nation)
    SELECT id, kind, target FROM r WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.kind = r.kind AND g.target = r.target)""",
)
def polymorphic_dangling(t: Tables) -> DataFrame:
    kind = F.element_at(F.array(F.lit("strain"), F.lit("product"), F.lit("nation")), (F.col("event_id") % 3 + 1).cast("int"))
    r = t.events.select(F.col("event_id").alias("id"), kind.alias("kind"), (F.col("event_id") % 130).alias("target"))
    known = [df.select(F.lit(k).alias("kind"), F.col(c).cast("long").alias("target")) for k, df, c in (("strain", t.v_strain, "strain_id"), ("product", t.v_product, "product_id"), ("nation", t.nation, "n_nationkey"))]
    return r.join(known[0].union(known[1]).union(known[2]), ["kind", "target"], "left_anti").select("id", "kind", "target")


@query(
    "multi_key_bridge",
    """WITH k AS (SELECT c_custkey AS id, unnest(['c' || c_custkey, 'n' || lower(c_name), 'p' || (c_custkey * 7)]) AS key FROM customer),
    w AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'c' || o_custkey WHEN 1 THEN 'p' || (o_custkey * 7) ELSE 'x' || o_custkey END AS key FROM orders)
    SELECT w.o_orderkey, k.id FROM w JOIN k ON w.key = k.key""",
)
def multi_key_bridge(t: Tables) -> DataFrame:
    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    key = F.col("c_custkey")
    k = t.customer.select(key.alias("id"), F.explode(F.array(text("c", key), text("n", F.lower("c_name")), text("p", key * 7))).alias("key"))
    c = F.col("o_custkey")
    w = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, text("c", c)).when(F.col("o_orderkey") % 3 == 1, text("p", c * 7)).otherwise(text("x", c)).alias("key"))
    return w.join(k, "key").select("o_orderkey", "id")


_SPACES = (("systematic", "concat('P', product_id)"), ("symbol", "lower(name)"), ("name", "name"), ("alias", "concat(tier, '/', carbons)"), ("family", "family"), ("tier", "tier"))
_ALIASES = " UNION ALL ".join(f"SELECT {i} AS priority, {text} AS alias, product_id AS anchor FROM v_product" for i, (_, text) in enumerate(_SPACES))


@query(
    "entity_resolution",
    f"""WITH a AS ({_ALIASES}), w AS (SELECT p_partkey AS id, unnest(CASE p_partkey % 4 WHEN 0 THEN [p_type, 'P' || p_partkey] WHEN 1 THEN [p_brand || '/' || p_size] WHEN 2 THEN [p_name || '?', 'nobody'] ELSE [p_name, p_type] END) AS alias FROM part),
    u AS (SELECT priority, alias, count(DISTINCT anchor) AS n, min(anchor) AS anchor FROM a GROUP BY priority, alias)
    SELECT w.id, arg_min(u.anchor, u.priority) FILTER (u.n = 1) AS anchor,
      CASE WHEN count(*) FILTER (u.n = 1) > 0 THEN 'resolved' WHEN count(u.n) > 0 THEN 'ambiguous' ELSE 'unknown' END AS verdict
    FROM w LEFT JOIN u ON u.alias = w.alias GROUP BY w.id""",
)
def entity_resolution(t: Tables) -> DataFrame:
    spaces = [t.v_product.select(F.lit(i).alias("priority"), F.expr(text).alias("alias"), F.col("product_id").alias("anchor")) for i, (_, text) in enumerate(_SPACES)]
    aliases = spaces[0]
    for s in spaces[1:]:
        aliases = aliases.union(s)
    k, key = F.col("p_partkey") % 4, F.concat(F.lit("P"), F.col("p_partkey").cast("string"))
    names = F.when(k == 0, F.array("p_type", key)).when(k == 1, F.array(F.concat_ws("/", "p_brand", F.col("p_size").cast("string")))).when(k == 2, F.array(F.concat("p_name", F.lit("?")), F.lit("nobody"))).otherwise(F.array("p_name", "p_type"))
    return R.resolve(t.part.select(F.col("p_partkey").alias("id"), F.explode(names).alias("alias")), aliases, "id")


@query("alias_union", "SELECT s_name AS alias, 'supplier' AS origin FROM supplier UNION SELECT c_name, 'customer' FROM customer UNION SELECT s_name, 'supplier' FROM supplier")
def alias_union(t: Tables) -> DataFrame:
    s = t.supplier.select(F.col("s_name").alias("alias"), F.lit("supplier").alias("origin"))
    return s.unionByName(t.customer.select(F.col("c_name").alias("alias"), F.lit("customer").alias("origin"))).unionByName(s).distinct()


@query(
    "dup_natural_key",
    """WITH o AS (SELECT * FROM v_measurement WHERE line <= 3), n AS (SELECT * FROM v_measurement WHERE line > 3)
    SELECT n.measurement_id AS new_id, o.measurement_id AS old_id, CASE WHEN n.sample_id IS NOT NULL AND o.sample_id IS NULL THEN 'sample_id' ELSE '' END AS adds
    FROM n JOIN o ON n.experiment_id = o.experiment_id AND n.quantity_kind = o.quantity_kind AND n.unit = o.unit AND n.discount = o.discount AND n.tax = o.tax""",
)
def dup_natural_key(t: Tables) -> DataFrame:
    m, key = t.v_measurement, ["experiment_id", "quantity_kind", "unit", "discount", "tax"]
    n = m.where("line > 3").select(*key, F.col("measurement_id").alias("new_id"), F.col("sample_id").alias("new_sample"))
    o = m.where("line <= 3").select(*key, F.col("measurement_id").alias("old_id"), F.col("sample_id").alias("old_sample"))
    adds = F.array_compact(F.array(F.when(F.col("new_sample").isNotNull() & F.col("old_sample").isNull(), F.lit("sample_id"))))
    return n.join(o, key).select("new_id", "old_id", F.array_join(adds, ",").alias("adds"))


@query("graph_edges", "SELECT DISTINCT CASE WHEN role = 'substrate' THEN 'm' || metabolite_id ELSE 'r' || reaction_id END AS src, CASE WHEN role = 'substrate' THEN 'r' || reaction_id ELSE 'm' || metabolite_id END AS dst FROM v_participant")
def graph_edges(t: Tables) -> DataFrame:
    m, r = F.concat(F.lit("m"), F.col("metabolite_id").cast("string")), F.concat(F.lit("r"), F.col("reaction_id").cast("string"))
    into = F.col("role") == "substrate"
    return t.v_participant.select(F.when(into, m).otherwise(r).alias("src"), F.when(into, r).otherwise(m).alias("dst")).distinct()


@query("pathway_nested", "SELECT reaction_id, string_agg(line || ':' || metabolite_id || ':' || role, ';' ORDER BY line, metabolite_id, role) AS participants FROM v_participant GROUP BY reaction_id")
def pathway_nested(t: Tables) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("line", "metabolite_id", "role")))  # as many as a reaction has
    text = F.transform(rows, lambda x: F.concat_ws(":", x["line"].cast("string"), x["metabolite_id"].cast("string"), x["role"]))
    return t.v_participant.groupBy("reaction_id").agg(F.array_join(text, ";").alias("participants"))


@query(
    "set_equality_join",
    """WITH a AS (SELECT l_orderkey AS id, string_agg(DISTINCT l_returnflag || l_linestatus, ',' ORDER BY l_returnflag || l_linestatus) AS k FROM lineitem GROUP BY 1),
    b AS (SELECT s_nationkey AS id, 'x' AS k FROM supplier WHERE false UNION ALL SELECT 1, 'AF' UNION ALL SELECT 2, 'AF,NO' UNION ALL SELECT 3, 'AF,RF')
    SELECT a.id, b.id AS construct FROM a JOIN b ON a.k = b.k""",
)
def set_equality_join(t: Tables) -> DataFrame:
    sets = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_set(F.concat("l_returnflag", "l_linestatus"))).alias("k"))
    b = t._spark.createDataFrame([(1, ["AF"]), (2, ["NO", "AF"]), (3, ["AF", "RF"])], "construct int, k array<string>").withColumn("k", F.array_sort("k"))
    return sets.join(F.broadcast(b), "k").select("id", "construct")


@query(
    "page_side_fetch",
    """WITH p AS (SELECT strain_id FROM v_strain ORDER BY score DESC, strain_id LIMIT 20)
    SELECT p.strain_id, count(f.target_id) AS flags FROM p LEFT JOIN v_flag f ON f.target_id = p.strain_id GROUP BY p.strain_id""",
)
def page_side_fetch(t: Tables) -> DataFrame:
    p = t.v_strain.orderBy(F.col("score").desc(), "strain_id").limit(20).select("strain_id")
    return p.join(t.v_flag, F.col("strain_id") == F.col("target_id"), "left").groupBy("strain_id").agg(F.count("target_id").alias("flags"))


@query("tolerance_match", "SELECT a.context_id AS a, b.context_id AS b FROM v_context a JOIN v_context b ON a.feedstock = b.feedstock AND a.aeration = b.aeration AND a.context_id < b.context_id AND abs(a.temperature_c - b.temperature_c) <= 2 AND abs(a.sugar - b.sugar) <= 0.25 * greatest(abs(a.sugar), abs(b.sugar))")
def tolerance_match(t: Tables) -> DataFrame:
    # windows of two bands of the tolerance's width make it an equi-join; a pair counts in the window of its higher band
    c = t.v_context.select("context_id", "feedstock", "aeration", "temperature_c", "sugar", F.floor(F.col("temperature_c") / 2).alias("band"))
    c = c.withColumn("window", F.explode(F.array(F.col("band"), F.col("band") + 1)))
    p = R.pairs_within(c, ["feedstock", "aeration", "window"], "context_id").where(F.col("window") == F.greatest("x.band", "y.band"))
    p = p.where((F.abs(F.col("x.temperature_c") - F.col("y.temperature_c")) <= 2) & (F.abs(F.col("x.sugar") - F.col("y.sugar")) <= 0.25 * F.greatest(F.abs("x.sugar"), F.abs("y.sugar"))))
    return p.select(F.least("x.context_id", "y.context_id").alias("a"), F.greatest("x.context_id", "y.context_id").alias("b"))


# ---------------------------------------------------------------- sorting and paging


@query("sort_multi", "SELECT strain_id, organism_id, row_number() OVER (ORDER BY organism_id ASC NULLS FIRST, score DESC NULLS LAST, strain_id) AS place FROM v_strain")
def sort_multi(t: Tables) -> DataFrame:
    order = Window.partitionBy(F.lit(1)).orderBy("organism_id", F.col("score").desc(), "strain_id")  # a vocabulary-sized list
    return t.v_strain.select("strain_id", "organism_id", F.row_number().over(order).alias("place").cast("long").alias("place"))


@query("page_truncation", "SELECT feature_id, position, true AS truncated FROM (SELECT feature_id, row_number() OVER (ORDER BY start_pos, feature_id) AS position FROM v_feature ORDER BY start_pos, feature_id LIMIT 25 OFFSET 50) WHERE true")
def page_truncation(t: Tables) -> DataFrame:
    p = R.page(t.v_feature, [F.col("start_pos"), F.col("feature_id")], 25, 50)
    return p.select("feature_id", (F.col("position") + 50).alias("position"), "truncated")


@query("order_by_named", "SELECT product_id FROM v_product ORDER BY ceiling DESC, product_id LIMIT 15")
def order_by_named(t: Tables) -> DataFrame:
    orderings = {"name": [F.col("name")], "ceiling": [F.col("ceiling").desc(), F.col("product_id")], "id": [F.col("product_id")]}
    return t.v_product.orderBy(*orderings["ceiling"]).limit(15).select("product_id")


@query("natural_order", "SELECT seqid, row_number() OVER (ORDER BY CASE seqid WHEN 'IV' THEN 4 WHEN 'IX' THEN 9 WHEN 'V' THEN 5 WHEN 'X' THEN 10 ELSE 99 END, seqid) AS place FROM (VALUES ('IX'), ('V'), ('Mito'), ('IV'), ('X')) v(seqid)")
def natural_order(t: Tables) -> DataFrame:
    rows = t._spark.createDataFrame([(x,) for x in ("IX", "V", "Mito", "IV", "X")], "seqid string")
    roman = ("I II III IV V VI VII VIII IX X XI XII XIII XIV XV XVI").split()
    ordinal = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for i, r in enumerate(roman) for x in (r, i + 1))), F.col("seqid")), F.lit(99))
    return rows.select("seqid", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(ordinal, "seqid")).cast("long").alias("place"))


@query("rank_one_axis", "SELECT context_id, sugar FROM v_context ORDER BY sugar DESC, context_id LIMIT 25")
def rank_one_axis(t: Tables) -> DataFrame:
    return t.v_context.orderBy(F.col("sugar").desc(), "context_id").limit(25).select("context_id", "sugar")


@query("lexicographic_rank", "SELECT part_id FROM (SELECT part_id, step_role, compartment, coalesce(CASE WHEN part_id % 3 = 0 THEN NULL ELSE part_id % 7 END, 0) AS fit FROM v_route_part) ORDER BY step_role, fit DESC, compartment, part_id LIMIT 20")
def lexicographic_rank(t: Tables) -> DataFrame:
    fit = F.coalesce(F.when(F.col("part_id") % 3 == 0, None).otherwise(F.col("part_id") % 7), F.lit(0))  # no fit reads as 0
    return t.v_route_part.withColumn("fit", fit).orderBy("step_role", F.col("fit").desc(), "compartment", "part_id").limit(20).select("part_id")


@query("rank_explain", "SELECT part_id, 'role ' || step_role || '; in ' || compartment || '; fit ' || (part_id % 7) AS why FROM v_route_part")
def rank_explain(t: Tables) -> DataFrame:
    s = lambda c: c.cast("string")
    return t.v_route_part.select("part_id", F.concat(F.lit("role "), s(F.col("step_role")), F.lit("; in "), "compartment", F.lit("; fit "), s(F.col("part_id") % 7)).alias("why"))


@query("topk_rerank", "SELECT product_id, saturated FROM (SELECT product_id, carbons, ceiling, true AS saturated FROM (SELECT * FROM v_product ORDER BY ceiling DESC, product_id LIMIT 100)) ORDER BY carbons DESC, ceiling DESC, product_id LIMIT 10")
def topk_rerank(t: Tables) -> DataFrame:
    limit = 10
    size = max(100, 10 * limit)
    pool = t.v_product.orderBy(F.col("ceiling").desc(), "product_id").limit(size + 1)
    w = Window.partitionBy(F.lit(1))  # over the pool only
    pool = pool.withColumn("place", F.row_number().over(w.orderBy(F.col("ceiling").desc(), "product_id"))).withColumn("saturated", F.max("place").over(w) > size).where(F.col("place") <= size)
    return pool.orderBy(F.col("carbons").desc(), F.col("ceiling").desc(), "product_id").limit(limit).select("product_id", "saturated")


@query("queue_peek", "SELECT task_id, priority FROM v_queue WHERE status = 'pending' ORDER BY priority, created_at, task_id LIMIT 10")
def queue_peek(t: Tables) -> DataFrame:
    return t.v_queue.where("status = 'pending'").orderBy("priority", "created_at", "task_id").limit(10).select("task_id", "priority")


@query("priority_score", "SELECT doc_id, (CASE WHEN text ILIKE '%license%' THEN 1 WHEN text ILIKE '%the%' THEN 2 ELSE 3 END) * 2 - CASE WHEN regexp_matches(text, '[0-9]') THEN 1 ELSE 0 END AS priority FROM v_document")
def priority_score(t: Tables) -> DataFrame:
    tier = F.when(F.col("text").ilike("%license%"), 1).when(F.col("text").ilike("%the%"), 2).otherwise(3)
    return t.v_document.select("doc_id", (tier * 2 - F.when(F.col("text").rlike("[0-9]"), 1).otherwise(0)).alias("priority"))


# ---------------------------------------------------------------- set operations


@query("union_all_best", "SELECT entity, min(rank) AS best FROM (SELECT strain_id AS entity, line AS rank FROM v_measurement UNION ALL SELECT product_id, line FROM v_measurement) x GROUP BY entity")
def union_all_best(t: Tables) -> DataFrame:
    m = t.v_measurement
    both = m.select(F.col("strain_id").alias("entity"), F.col("line").alias("rank")).unionAll(m.select("product_id", "line"))
    return both.groupBy("entity").agg(F.min("rank").alias("best"))


@query("union_distinct", "SELECT n_name AS name FROM nation UNION SELECT r_name FROM region")
def union_distinct(t: Tables) -> DataFrame:
    return t.nation.select(F.col("n_name").alias("name")).union(t.region.select("r_name")).distinct()


@query("set_difference", "SELECT product_id FROM v_product EXCEPT SELECT product_id FROM v_measurement WHERE quantity_kind = 'A' AND value > 30")
def set_difference(t: Tables) -> DataFrame:
    return t.v_product.select("product_id").subtract(t.v_measurement.where("quantity_kind = 'A' AND value > 30").select("product_id"))


@query("set_intersect", "SELECT product_id FROM v_measurement WHERE quantity_kind = 'A' AND value > 47 INTERSECT SELECT product_id FROM v_measurement WHERE quantity_kind = 'R' AND value > 47")
def set_intersect(t: Tables) -> DataFrame:
    m = t.v_measurement.where("value > 47")
    return m.where("quantity_kind = 'A'").select("product_id").intersect(m.where("quantity_kind = 'R'").select("product_id"))


@query("subset_test", "SELECT l_orderkey AS id, bool_and(l_returnflag IN ('A', 'R')) AS inside FROM lineitem GROUP BY l_orderkey")
def subset_test(t: Tables) -> DataFrame:
    allowed = F.array(F.lit("A"), F.lit("R"))
    return t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg((F.size(F.array_except(F.collect_set("l_returnflag"), allowed)) == 0).alias("inside"))


# ---------------------------------------------------------------- sinks


@query("upsert_ignore", "SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'new ' || c_name FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 <> 0")
def upsert_ignore(t: Tables) -> DataFrame:
    c = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return R.upsert_ignore(c.where("id % 2 = 0"), c.where("id % 3 = 0").withColumn("name", F.concat(F.lit("new "), "name")), ["id"])


@query("upsert_update", "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'new ' || c_name ELSE c_name END AS name, c_nationkey AS nation FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0")
def upsert_update(t: Tables) -> DataFrame:
    c = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    return R.upsert_update(c.where("id % 2 = 0"), c.where("id % 3 = 0").withColumn("name", F.concat(F.lit("new "), "name")), ["id"], ["name"])


_OLD = "SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END AS segment, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_nationkey END AS nation FROM customer"


@query(
    "merge_fill_only",
    f"""WITH o AS ({_OLD}), n AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 6 = 0 THEN 'OTHER' ELSE c_mktsegment END AS segment, c_nationkey AS nation FROM customer WHERE c_custkey % 2 = 0)
    SELECT o.id, coalesce(o.segment, n.segment) AS segment, coalesce(o.nation, n.nation) AS nation, CASE WHEN o.segment <> n.segment THEN 'segment' ELSE '' END AS disagreements
    FROM o LEFT JOIN n ON o.id = n.id""",
)
def merge_fill_only(t: Tables) -> DataFrame:
    c = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))
    old = c.withColumn("segment", F.when(F.col("id") % 4 != 0, F.col("segment"))).withColumn("nation", F.when(F.col("id") % 5 != 0, F.col("nation")))
    new = c.where("id % 2 = 0").withColumn("segment", F.when(F.col("id") % 6 == 0, "OTHER").otherwise(F.col("segment")))
    out = R.merge_fill_only(old, new, ["id"], ["segment", "nation"])
    return out.withColumn("disagreements", F.array_join("disagreements", ","))


@query("protected_upsert", "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 OR s_suppkey % 2 <> 0 THEN s_name ELSE 'bulk' END AS label FROM supplier")
def protected_upsert(t: Tables) -> DataFrame:
    old = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("label"), F.when(F.col("s_suppkey") % 3 == 0, "curator").alias("curator"))
    new = old.where("id % 2 = 0").withColumn("label", F.lit("bulk")).drop("curator")
    allowed = new.join(old.where("curator IS NOT NULL"), "id", "left_anti")  # a curator's rows are never overwritten
    return R.upsert_update(old.drop("curator"), allowed, ["id"], ["label"])


@query("flag_upsert", "SELECT target_id, CASE WHEN status <> 'active' THEN status ELSE 'active' END AS status, CASE WHEN status <> 'active' THEN statistic ELSE statistic - 1 END AS statistic FROM v_flag")
def flag_upsert(t: Tables) -> DataFrame:
    old, raised = t.v_flag.select("target_id", "status", "statistic"), t.v_flag.select("target_id", (F.col("statistic") - 1).alias("again"))
    j = old.join(raised, "target_id", "full_outer")
    closed = F.col("status").isNotNull() & (F.col("status") != "active")  # a resolved flag is never reopened
    return j.select("target_id", F.when(closed, F.col("status")).otherwise("active").alias("status"), F.when(closed, F.col("statistic")).otherwise(F.coalesce("again", "statistic")).alias("statistic"))


@query("export_zone_counts", "SELECT CASE WHEN doc_id % 10 = 0 THEN 'I' WHEN quality IS NULL THEN 'R' ELSE 'H' END AS zone, count(*) AS n, count(*) FILTER (quality IS NULL) AS absent_quality FROM v_document GROUP BY 1")
def export_zone_counts(t: Tables) -> DataFrame:
    zone = F.when(F.col("doc_id") % 10 == 0, "I").when(F.col("quality").isNull(), "R").otherwise("H")
    return t.v_document.groupBy(zone.alias("zone")).agg(F.count("*").alias("n"), F.count_if(F.col("quality").isNull()).alias("absent_quality"))


@query("worklist_export", "SELECT task_id, priority, status FROM v_queue WHERE status = 'in_progress' ORDER BY priority, task_id")
def worklist_export(t: Tables) -> DataFrame:
    return t.v_queue.where("status = 'in_progress'").orderBy("priority", "task_id").select("task_id", "priority", "status")


@query(
    "rebuild_diff",
    """SELECT id, kind, changed FROM (
    SELECT c_custkey AS id, CASE WHEN c_custkey % 11 = 0 THEN 'missing' WHEN c_custkey % 13 = 0 THEN 'added' WHEN c_custkey % 7 = 0 THEN 'changed' END AS kind,
      CASE WHEN c_custkey % 11 <> 0 AND c_custkey % 13 <> 0 AND c_custkey % 7 = 0 THEN 'name' ELSE '' END AS changed FROM customer WHERE NOT (c_custkey % 11 = 0 AND c_custkey % 13 = 0)) WHERE kind IS NOT NULL""",
)
def rebuild_diff(t: Tables) -> DataFrame:
    c = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    rebuilt = c.where("id % 11 <> 0").withColumn("name", F.when(F.col("id") % 7 == 0, F.upper(F.concat("name", F.lit("!")))).otherwise(F.col("name")))
    return R.rebuild_diff(c.where("id % 13 <> 0"), rebuilt, ["id"], ["name", "nation"])
