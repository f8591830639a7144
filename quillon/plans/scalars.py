"""Queries of scalar functions: text, numbers, JSON, states, sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import grammar as G
from quillon.functions import payload as P
from quillon.functions import sections as SEC
from quillon.functions import sequence as Q
from quillon.functions import text as X
from quillon.registry import query
from quillon.sources import blobs as B
from quillon.sources import store
from quillon.sources.files import location
from quillon.sources.jats import article_texts
from quillon.sources.landed import first_hit, go_annotations, search_ids, series
from quillon.sources.standins import Tables


@query("tokenize", "SELECT doc_id, len(tk) AS n, array_to_string(tk[1:8], ' ') AS head FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS tk FROM documents) x")
def tokenize(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.tokens(F.col("text")).alias("tk")).select("doc_id", F.size("tk").cast("long").alias("n"), F.array_join(F.slice("tk", 1, 8), " ").alias("head"))


@query("normalize_title", "SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^\\p{L}\\p{N}\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS title FROM documents")
def normalize_title(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.normalize_title(F.col("text")).alias("title"))


@query("extract_id", "SELECT page_id, nullif(regexp_extract(lower(url), '/([a-z]{2})/([0-9]+)', 2), '') AS number, nullif(regexp_extract(lower(url), '/([a-z]{2})/([0-9]+)', 1), '') || ':' || nullif(regexp_extract(lower(url), '/([a-z]{2})/([0-9]+)', 2), '') AS canonical FROM pages")
def extract_id(t: Tables) -> DataFrame:
    part = lambda i: F.nullif(F.regexp_extract(F.lower("url"), "/([a-z]{2})/([0-9]+)", i), F.lit(""))
    return t.pages.select("page_id", part(2).alias("number"), F.concat(part(1), F.lit(":"), part(2)).alias("canonical"))


@query("parse_year", "SELECT doc_id, TRY_CAST(nullif(regexp_extract('published ' || year || CASE WHEN doc_id % 4 = 0 THEN '' ELSE '-03' END, '(19|20)[0-9]{2}'), '') AS INT) AS parsed FROM v_document")
def parse_year(t: Tables) -> DataFrame:
    shown = F.concat(F.lit("published "), F.col("year").cast("string"), F.when(F.col("doc_id") % 4 == 0, "").otherwise("-03"))
    return t.v_document.select("doc_id", F.nullif(F.regexp_extract(shown, "(19|20)[0-9]{2}", 0), F.lit("")).try_cast("int").alias("parsed"))


@query("slugify", "SELECT p_partkey, 'part:' || regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS curie FROM part")
def slugify(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.concat(F.lit("part:"), X.slug(F.col("p_name"))).alias("curie"))


@query("stable_digest", """SELECT p_partkey, substr(sha256('{"brand":"' || p_brand || '","size":' || p_size || '}'), 1, 16) AS digest FROM part""")
def stable_digest(t: Tables) -> DataFrame:
    payload = F.to_json(F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size")))  # keys in a fixed order
    return t.part.select("p_partkey", F.substr(F.sha2(payload, 256), F.lit(1), F.lit(16)).alias("digest"))


@query("proposal_hash", """SELECT measurement_id, sha256('{"kind":"' || quantity_kind || '","unit":"' || unit || '","product":' || product_id || '}') AS h FROM v_measurement""")
def proposal_hash(t: Tables) -> DataFrame:
    # what is hashed leaves the span's offsets out
    record = F.struct(F.col("quantity_kind").alias("kind"), "unit", F.col("product_id").alias("product"))
    return t.v_measurement.select("measurement_id", F.sha2(F.to_json(record), 256).alias("h"))


_CTX = "sha256('aeration=' || aeration || '|feedstock=' || feedstock || '|temperature=' || temperature_c)"


@query("context_hash", f"SELECT context_id, {_CTX} AS h FROM v_context")
def context_hash(t: Tables) -> DataFrame:
    facets = F.array(F.concat(F.lit("temperature="), F.col("temperature_c").cast("string")), F.concat(F.lit("feedstock="), "feedstock"), F.concat(F.lit("aeration="), "aeration"))
    return t.v_context.select("context_id", F.sha2(F.array_join(F.array_sort(facets), "|"), 256).alias("h"))


@query("context_collisions", "SELECT aeration || '|' || feedstock AS k, count(*) AS contexts FROM v_context GROUP BY 1 HAVING count(DISTINCT temperature_c) > 1")
def context_collisions(t: Tables) -> DataFrame:
    # contexts that become one when the temperature facet is dropped
    facets = F.array(F.struct(F.lit("aeration").alias("f"), F.col("aeration").alias("v")), F.struct(F.lit("feedstock").alias("f"), F.col("feedstock").alias("v")), F.struct(F.lit("temperature").alias("f"), F.col("temperature_c").cast("string").alias("v")))
    kept = F.transform(F.filter(facets, lambda x: x["f"] != "temperature"), lambda x: x["v"])
    g = t.v_context.groupBy(F.array_join(kept, "|").alias("k")).agg(F.count("*").alias("contexts"), F.count_distinct("temperature_c").alias("d"))
    return g.where("d > 1").select("k", "contexts")


@query("normalize_text")
def normalize_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.nfkc("text").alias("normal"))


@query("corroborate_number", "SELECT p_partkey, true AS number_found, p_size % 3 <> 2 AS unit_found FROM part")
def corroborate_number(t: Tables) -> DataFrame:
    unit = F.element_at(F.array(F.lit("g L−1"), F.lit("grams  per liter"), F.lit("mmol")), (F.col("p_size") % 3 + 1).cast("int"))
    quote = X.nfkc(F.concat(F.lit("It reached "), F.col("p_size").cast("string"), F.lit(" "), unit))
    found = X.names_number(quote, F.concat(F.col("p_size").cast("string"), F.lit(".0")))
    return t.part.select("p_partkey", found.alias("number_found"), X.names_unit(quote, F.lit("g/L")).alias("unit_found"))


_NAMED = "CASE p_size % 4 WHEN 0 THEN cast(p_size AS VARCHAR(20)) WHEN 1 THEN concat(p_name, ' and ', p_type) WHEN 2 THEN concat('x, ', p_brand) ELSE p_brand END"


@query("distinguishing", f"SELECT p_partkey, NOT regexp_full_match(trim(v), '[0-9]+') AS distinct_name, len(list_filter(regexp_split_to_array(v, ',|\\band\\b|\\bor\\b|/'), lambda x: length(trim(x)) >= 3)) <= 1 AS one_thing FROM (SELECT p_partkey, {_NAMED} AS v FROM part) x")
def distinguishing(t: Tables) -> DataFrame:
    v = F.expr(_NAMED.replace("VARCHAR(20)", "STRING"))
    return t.part.select("p_partkey", X.distinguishing(v).alias("distinct_name"), X.names_one_thing(v).alias("one_thing"))


@query(
    "verify_span",
    """SELECT d.doc_id, b.item_id, CASE WHEN substr(d.text, 11, length(b.text)) = b.text THEN 'exact' WHEN (length(d.text) - length(replace(d.text, b.text, ''))) // length(b.text) = 1 THEN 'moved'
    WHEN contains(d.text, b.text) THEN 'ambiguous' ELSE 'absent' END AS verdict FROM documents d JOIN benchmark b ON d.doc_id % 40 = b.item_id % 40""",
)
def verify_span(t: Tables) -> DataFrame:
    b = t.benchmark.select("item_id", F.col("text").alias("quote"), (F.col("item_id") % 40).alias("k"))
    d = t.documents.withColumn("k", F.col("doc_id") % 40)
    return d.join(b, "k").select("doc_id", "item_id", X.span_verdict(F.col("text"), F.lit(10), F.col("quote")).alias("verdict"))


@query("find_all", "SELECT p_partkey, array_to_string(list_transform(list_filter(range(1, length(p_name) + 1), lambda i: substr(p_name, i, 1) = 'a'), lambda i: i - 1), ',') AS places FROM part")
def find_all(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.array_join(X.find_all(F.col("p_name"), F.lit("a")), ",").alias("places"))


@query("snippet", "SELECT doc_id, trim(regexp_replace(substr(text, greatest(1, strpos(text, 'License') - 30), 67), '\\s+', ' ', 'g')) AS snip FROM documents WHERE contains(text, 'License')")
def snippet(t: Tables) -> DataFrame:
    at = F.greatest(F.lit(1), F.locate("License", F.col("text")) - 30)
    return t.documents.where(F.col("text").contains("License")).select("doc_id", X.collapse(F.substr(F.col("text"), at, F.lit(67))).alias("snip"))


#: Sections of v_paper once more, line by line: l lines, h headings, s sections, r the leading run, f folded.
_SECTIONS = """l AS (SELECT doc_id, text, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS line FROM v_paper),
    o AS (SELECT *, (sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(line) - 1)::BIGINT AS pos,
      trim(lower(regexp_replace(regexp_extract(line, '^[ \\t]*(#{1,6}[ \\t]*)?([0-9]+([.][0-9]+)*[.)]?[ \\t]*)?[*]{0,2}([A-Za-z].{0,60}?)[*]{0,2}[ \\t]*:?[ \\t]*$', 4), '[ \\t]+', ' ', 'g')), ' .') AS said FROM l),
    h AS (SELECT *, CASE WHEN regexp_full_match(said, 'results? and discussions?') THEN 'results_and_discussion'
      WHEN regexp_full_match(said, '(materials? and )?methods?|methods? and materials?|experimental( (procedures?|section|methods?|details?))?') THEN 'methods'
      WHEN regexp_full_match(said, 'results?') THEN 'results' WHEN regexp_full_match(said, 'discussions?') THEN 'discussion'
      WHEN said IN ('abstract', 'summary') THEN 'abstract' WHEN said IN ('introduction', 'background') THEN 'introduction'
      WHEN regexp_full_match(said, 'conclusions?|concluding remarks') THEN 'conclusion' WHEN regexp_full_match(said, 'acknowledge?ments?') THEN 'acknowledgements'
      WHEN regexp_full_match(said, 'references?|bibliography|literature cited') THEN 'references' WHEN regexp_full_match(said, 'supplement(ary|al)( [a-z0-9_]+)*') THEN 'supplementary' END AS name FROM o),
    g AS (SELECT *, count(name) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM h),
    s AS (SELECT doc_id, k, coalesce(max(name) FILTER (k > 0), 'front_matter') AS name, min(pos) AS start_pos, coalesce(lead(min(pos)) OVER (PARTITION BY doc_id ORDER BY k), max(length(text))) AS end_pos FROM g GROUP BY doc_id, k),
    r AS (SELECT *, sum(end_pos - start_pos) OVER w AS chars, row_number() OVER (PARTITION BY doc_id, name ORDER BY k) AS turn FROM s WHERE k > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
    e AS (SELECT doc_id, coalesce(min(k) FILTER (name NOT IN ('abstract', 'introduction', 'methods', 'results', 'results_and_discussion', 'discussion', 'conclusion') OR turn > 1 OR end_pos - start_pos > 2000 OR chars > 6000), max(k) + 1) AS stop FROM r GROUP BY doc_id),
    p AS (SELECT r.doc_id, any_value(stop) AS stop, arg_min(r.name, k) AS opener FROM r JOIN e ON e.doc_id = r.doc_id WHERE k < stop AND r.name IN ('introduction', 'methods', 'results', 'results_and_discussion') GROUP BY r.doc_id),
    q AS (SELECT DISTINCT p.doc_id, stop FROM p JOIN s ON s.doc_id = p.doc_id AND s.k >= stop AND s.name = opener),
    f AS (SELECT s.doc_id, CASE WHEN s.k > 0 AND s.k < coalesce(q.stop, 0) THEN 1 ELSE s.k END AS k, min(CASE WHEN s.k > 0 AND s.k < coalesce(q.stop, 0) THEN 'abstract' ELSE s.name END) AS name, min(start_pos) AS start_pos, max(end_pos) AS end_pos
      FROM s LEFT JOIN q ON q.doc_id = s.doc_id GROUP BY s.doc_id, 2)"""


@query("split_sections", f"WITH {_SECTIONS} SELECT doc_id, name, start_pos, end_pos FROM f")
def split_sections(t: Tables) -> DataFrame:
    d = t.v_paper.select("doc_id", F.explode(SEC.split_sections(F.col("text"))).alias("s"))
    return d.select("doc_id", "s.name", F.col("s.start").cast("long").alias("start_pos"), F.col("s.end").cast("long").alias("end_pos"))


@query(
    "excerpt_offsets",
    f"""WITH {_SECTIONS}, c AS (SELECT *, length(name) + 14 + end_pos - start_pos AS size FROM f WHERE name IN ('methods', 'results_and_discussion', 'abstract')),
    x AS (SELECT *, sum(size + 2) OVER (PARTITION BY doc_id ORDER BY start_pos) - 2 AS done FROM c)
    SELECT x.doc_id, x.name, x.start_pos AS doc_start, (done - (end_pos - start_pos))::BIGINT AS exc_start, md5(substr(v.text, x.start_pos + 1, end_pos - start_pos)) AS piece FROM x JOIN v_paper v ON v.doc_id = x.doc_id""",
)
def excerpt_offsets(t: Tables) -> DataFrame:
    e = t.v_paper.select("doc_id", SEC.excerpt(F.col("text"), SEC.split_sections(F.col("text")), ["methods", "results_and_discussion", "abstract"]).alias("e"))
    p = e.select("doc_id", "e.text", F.explode("e.pieces").alias("p"))
    piece = F.substr(F.col("text"), F.col("p.exc_start") + 1, F.col("p.exc_end") - F.col("p.exc_start"))  # read from the excerpt, by its own offsets
    return p.select("doc_id", "p.name", F.col("p.doc_start").cast("long").alias("doc_start"), F.col("p.exc_start").cast("long").alias("exc_start"), F.md5(piece).alias("piece"))


@query("looks_like_review", f"WITH {_SECTIONS} SELECT doc_id, count(*) FILTER (name IN ('methods', 'results', 'results_and_discussion')) = 0 AND count(*) FILTER (name IN ('abstract', 'introduction', 'conclusion', 'discussion')) > 0 AS review FROM f GROUP BY doc_id")
def looks_like_review(t: Tables) -> DataFrame:
    return t.v_paper.select("doc_id", SEC.looks_like_review(SEC.split_sections(F.col("text"))).alias("review"))


_LICENCES = {"CC BY 4.0": "yes", "cc_by-nc": "unknown", "CC-BY-ND": "no", "CC0 1.0": "yes", "All rights reserved": "unknown", "": "unknown", "CC BY-NC-ND 4.0": "no"}


@query("licence_class", f"SELECT doc_id, ({list(_LICENCES.values())})[doc_id % {len(_LICENCES)} + 1] AS allowed FROM documents")
def licence_class(t: Tables) -> DataFrame:
    said = F.get(F.array(*map(F.lit, _LICENCES)), (F.col("doc_id") % len(_LICENCES)).cast("int"))
    return t.documents.select("doc_id", X.licence_class(said).alias("allowed"))


@query(
    "title_overlap",
    f"""WITH d AS (SELECT doc_id, string_split(text, chr(10))[1] AS title, substr(text, length(string_split(text, chr(10))[1]) + 2) AS opening FROM documents),
    w AS (SELECT *, list_filter(list_distinct(regexp_extract_all(lower(title), '[a-z][a-z0-9-]{{3,}}')), lambda x: NOT list_contains({X.TITLE_STOPWORDS}, x)) AS ws FROM d)
    SELECT doc_id, CASE WHEN len(ws) >= 3 AND trim(opening) <> '' THEN round(len(list_filter(ws, lambda x: contains(lower(opening), x))) / len(ws)::DOUBLE, 6) END AS overlap FROM w""",
)
def title_overlap(t: Tables) -> DataFrame:
    title = F.substring_index("text", "\n", 1)
    return t.documents.select("doc_id", F.round(X.title_overlap(title, F.expr("substring(text, length(substring_index(text, '\n', 1)) + 2)")), 6).alias("overlap"))


#: Parts that a stand-in's genotype has, as SQL over part: (kind, text, target).
_PARTS = [
    ("background", "'BY4741'", "'BY4741'"), ("plasmid", "concat('pAB', p_size, '-kivd-ADH6')", "concat('pAB', p_size)"), ("deletion", "concat('Δilv', p_partkey)", "concat('ilv', p_partkey)"),
    ("deletion", "concat('pdc', p_size, 'Δ')", "concat('pdc', p_size)"), ("deletion_with_insertion", "concat('Δpdc1::', 'MTH', p_size)", "'pdc1'"), ("deletion", "concat('Δmth1(+', p_size, '; +393)')", "'mth1'"),
    ("marker", "'SUC2'", "'SUC2'"), ("unparsed", "'what is this?'", "NULL"),
]
_GENOTYPE = "concat(" + ", '; ', ".join(text for _, text, _ in _PARTS).replace(", '; ', ", ", '/', ", 1) + ")"


def _spread(t: Tables, rows: DataFrame) -> DataFrame:
    """rows over all tasks: a small file holds many short rows, and each takes long to parse."""
    return rows.repartition(int(t._spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")


@query("genotype_parts", " UNION ALL ".join(f"SELECT p_partkey, {i} AS place, {text} AS token, '{kind}' AS kind, {target} AS target FROM part" for i, (kind, text, target) in enumerate(_PARTS)))
def genotype_parts(t: Tables) -> DataFrame:
    p = _spread(t, t.part.select("p_partkey", "p_size")).select("p_partkey", F.posexplode(G.parse_genotype(F.expr(_GENOTYPE))).alias("place", "p"))
    return p.select("p_partkey", "place", F.col("p.as_reported").alias("token"), "p.kind", "p.target")


@query(
    "construct_genes",
    "SELECT p_partkey, unnest(['ILV2', 'ILV5', 'adhA', 'ilvC']) AS gene, unnest(['cytosol', 'mitochondrial_matrix', 'mitochondrial_matrix', 'cytosol']) AS place, unnest([p_size % 90 + 1, NULL, NULL, NULL]) AS truncated, 'BY' || p_partkey AS parent FROM part",
)
def construct_genes(t: Tables) -> DataFrame:
    said = F.expr("concat('BY', p_partkey, ' with pTEF2-CoxIV-LlAdhA29C8_ScILV2N', p_size % 90 + 1, '_EcIlvC6E6; ScILV5')")
    found = G.parse_construct(said, {"ILV2": "mitochondrial_matrix", "ILV5": "mitochondrial_matrix"})
    g = _spread(t, t.part.select("p_partkey", "p_size")).select("p_partkey", F.explode(found).alias("g"), G.parent(said).alias("parent"))
    return g.select("p_partkey", "g.gene", "g.place", "g.truncated", "parent")


@query("parse_timepoint", "SELECT l_orderkey, l_linenumber, TRY_CAST(nullif(regexp_extract('T' || l_linenumber || CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE ' - hour ' || cast(l_quantity AS INT) END, 'hour ([0-9.]+)', 1), '') AS DOUBLE) AS hours FROM lineitem")
def parse_timepoint(t: Tables) -> DataFrame:
    n = F.col("l_linenumber")
    said = F.concat(F.lit("T"), n.cast("string"), F.when(n % 3 == 0, "").otherwise(F.concat(F.lit(" - hour "), F.round("l_quantity").cast("int").cast("string"))))
    return t.lineitem.select("l_orderkey", "l_linenumber", X.hours(said).alias("hours"))


_STATE = "CASE p_size % 4 WHEN 0 THEN NULL WHEN 1 THEN 'NA' WHEN 2 THEN 'unknown' ELSE p_brand END"


@query("three_state", f"SELECT p_partkey, CASE WHEN r IS NOT NULL AND r NOT IN ('NA', 'unknown') THEN r END AS value, CASE WHEN r IS NULL THEN 'not_recorded' WHEN r = 'NA' THEN 'not_applicable' WHEN r = 'unknown' THEN 'unknown' END AS absence FROM (SELECT p_partkey, {_STATE} AS r FROM part) x")
def three_state(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", X.three_state(F.expr(_STATE)).alias("v")).select("p_partkey", "v.value", "v.absence")


@query("quantity_display", "SELECT p_partkey, CASE WHEN p_size < 5 THEN '< ' WHEN p_size < 10 THEN '≤ ' ELSE '' END || p_size || ' g/L' AS shown FROM part")
def quantity_display(t: Tables) -> DataFrame:
    sign = F.when(F.col("p_size") < 5, "< ").when(F.col("p_size") < 10, "≤ ").otherwise("")
    return t.part.select("p_partkey", F.concat(sign, F.col("p_size").cast("string"), F.lit(" g/L")).alias("shown"))


@query("unit_convert", "SELECT m.measurement_id, m.product_id, round(m.value * u.factor, 6) AS si FROM v_measurement m JOIN (VALUES ('F', 0.001), ('O', 3.6)) u(unit, factor) ON m.unit = u.unit")
def unit_convert(t: Tables) -> DataFrame:
    units = t._spark.createDataFrame([("F", 0.001), ("O", 3.6)], "unit string, factor double")
    return t.v_measurement.join(F.broadcast(units), "unit").select("measurement_id", "product_id", F.round(F.col("value") * F.col("factor"), 6).alias("si"))


@query("pct_of_max", "SELECT product_id, round(100 * carbons / nullif(ceiling, 0), 6) AS pct FROM v_product")
def pct_of_max(t: Tables) -> DataFrame:
    return t.v_product.select("product_id", F.round(F.try_divide(100 * F.col("carbons"), F.col("ceiling")), 6).alias("pct"))


@query("json_extract", "SELECT event_id, cast(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def json_extract(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("json_coalesce", "SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN cast(event_id AS VARCHAR) END, json_extract_string(props, '$.k')) AS k FROM events")
def json_coalesce(t: Tables) -> DataFrame:
    edited = F.when(F.col("event_id") % 3 == 0, F.to_json(F.struct(F.col("event_id").cast("string").alias("k"))))
    return t.events.select("event_id", F.coalesce(F.get_json_object(edited, "$.k"), F.get_json_object("props", "$.k")).alias("k"))


@query(
    "json_flatten_diff",
    "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'only_left' WHEN 1 THEN 'only_right' WHEN 2 THEN 'differs' ELSE 'same' END AS verdict, CASE event_id % 4 WHEN 0 THEN 'r[1].k' WHEN 1 THEN 'r[1].m' WHEN 2 THEN 'r[0].v' ELSE '' END AS paths FROM events",
)
def json_flatten_diff(t: Tables) -> DataFrame:
    # two passes over one text, their records compared by position: a record lost, a field gained, a value changed
    base = F.expr("concat('{\"r\":[{\"v\":', event_id, ',\"k\":\"a\"},{\"v\":2,\"k\":null}]}')")
    k = F.col("event_id") % 4
    other = F.when(k == 0, F.replace(base, F.lit(',"k":null'), F.lit(""))).when(k == 1, F.replace(base, F.lit('"k":null'), F.lit('"k":null,"m":1'))).when(k == 2, F.replace(base, F.lit('"v":'), F.lit('"v":9'))).otherwise(base)
    passes = t.events.select("event_id", P.flatten(base).alias("first"), P.flatten(other).alias("second"))
    d = passes.select("event_id", P.disagreement(F.col("first"), F.col("second")).alias("d")).select("event_id", "d.*")
    named = F.when(F.size("only_left") > 0, "only_left").when(F.size("only_right") > 0, "only_right").when(F.size("differing") > 0, "differs").otherwise("same")
    paths = F.concat("only_left", "only_right", F.filter("differing", lambda p: ~p.startswith("r[1].v")))
    return d.select("event_id", named.alias("verdict"), F.array_join(paths, ",").alias("paths"))


@query(
    "schema_errors",
    "SELECT p_partkey, concat_ws(';', CASE WHEN p_size % 2 = 0 THEN '$.size: 0 is below the least, 1' END, CASE WHEN p_size % 5 = 0 THEN '$.tags[1]: expected string, got integer' END, CASE WHEN p_size % 3 = 0 THEN '$: brand is required' END) AS errors FROM part",
)
def schema_errors(t: Tables) -> DataFrame:
    size = F.when(F.col("p_size") % 2 == 0, 0).otherwise(F.col("p_size"))
    tags = F.when(F.col("p_size") % 5 == 0, '["a",2]').otherwise('["a"]')
    text = F.concat(F.lit('{"size":'), size.cast("string"), F.when(F.col("p_size") % 3 == 0, "").otherwise(',"brand":"x"'), F.lit(',"tags":'), tags, F.lit("}"))
    schema = {"type": "object", "required": ["brand"], "properties": {"size": {"type": "integer", "minimum": 1}, "brand": {"type": "string"}, "tags": {"type": "array", "items": {"type": "string"}}}}
    return t.part.select("p_partkey", F.array_join(F.array_sort(P.schema_errors(text, schema)), ";").alias("errors"))


@query("posexplode_kinds", "SELECT p_partkey, 'type' AS kind, generate_subscripts(string_split(p_type, ' '), 1) - 1 AS i, unnest(string_split(p_type, ' ')) AS record FROM part UNION ALL SELECT p_partkey, 'name', generate_subscripts(string_split(p_name, ' '), 1) - 1, unnest(string_split(p_name, ' ')) FROM part")
def posexplode_kinds(t: Tables) -> DataFrame:
    one = lambda k, c: t.part.select("p_partkey", F.lit(k).alias("kind"), F.posexplode(F.split(c, " ")).alias("i", "record"))
    both = one("type", "p_type").union(one("name", "p_name"))
    return both.withColumn("i", F.col("i").cast("long"))


@query("parse_json_text", """SELECT event_id, json_extract_string(regexp_extract('Sure: ```' || props || '```', '\\{.*\\}'), '$.k') AS k FROM events""")
def parse_json_text(t: Tables) -> DataFrame:
    reply = F.concat(F.lit("Sure: ```"), "props", F.lit("```"))
    return t.events.select("event_id", F.get_json_object(F.regexp_extract(reply, "(?s)\\{.*\\}", 0), "$.k").alias("k"))


@query("lease_expiry", "SELECT task_id, lease_expires_at FROM v_queue WHERE status = 'in_progress'")
def lease_expiry(t: Tables) -> DataFrame:
    return t.orders.where("o_orderstatus NOT IN ('O', 'F')").select(F.col("o_orderkey").alias("task_id"), (F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("lease_expires_at"))


@query("safe_cast", "SELECT p_partkey, TRY_CAST(regexp_replace(p_brand, 'Brand#', '', 'g') AS INT) AS brand_no, TRY_CAST(p_name AS DOUBLE) AS name_no FROM part")
def safe_cast(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.regexp_replace("p_brand", "Brand#", "").try_cast("int").alias("brand_no"), F.col("p_name").try_cast("double").alias("name_no"))


@query("recency", "SELECT doc_id, round(greatest(0.0, least(1.0, (year - 1990) / 30.0))::DOUBLE, 8) AS recency FROM v_document")
def recency(t: Tables) -> DataFrame:
    return t.v_document.select("doc_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("year") - 1990) / 30.0)), 8).alias("recency"))


@query("map_lookup", "SELECT event_id, CASE event_type WHEN 'purchase' THEN 'experimental' WHEN 'signup' THEN 'experimental' WHEN 'view' THEN 'computational' ELSE 'other' END AS category FROM events")
def map_lookup(t: Tables) -> DataFrame:
    table = F.create_map(*(F.lit(x) for x in ("purchase", "experimental", "signup", "experimental", "view", "computational")))
    return t.events.select("event_id", F.coalesce(F.try_element_at(table, F.col("event_type")), F.lit("other")).alias("category"))


@query("html_to_text", "SELECT page_id, length(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))) AS chars FROM pages")
def html_to_text(t: Tables) -> DataFrame:
    plain = F.regexp_replace(F.regexp_replace("html", "(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), "<[^>]*>", " ")
    return t.pages.select("page_id", F.length(X.collapse(plain)).cast("long").alias("chars"))


_XML = (
    "concat(CASE WHEN doc_id % 11 = 3 THEN '<html>' ELSE '<article>' END, '<front><article-meta><title-group><article-title>Paper <italic>', doc_id, '</italic></article-title></title-group><abstract><p>', replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'),"
    " '</p></abstract></article-meta></front><body><sec><title>Source</title><p>It is in <table-wrap><label>Table</label><table><tr><td>', coalesce(lang, ''), '</td><td>', n_chars, '</td></tr></table></table-wrap> here.</p></sec></body>', CASE WHEN doc_id % 11 = 3 THEN '</html>' WHEN doc_id % 11 = 4 THEN '' ELSE '</article>' END)"
)


@query(
    "article_text",
    """WITH d AS (SELECT doc_id, text IS NULL OR doc_id % 11 = 4 OR regexp_matches(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]') AS broken, doc_id % 11 = 3 AS other, trim(regexp_replace(text, '[\\s\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+', ' ', 'g')) AS body, lang, n_chars FROM documents)
    SELECT doc_id, CASE WHEN broken THEN 'no_xml' WHEN other THEN 'no_article' END AS refusal, CASE WHEN NOT broken AND NOT other THEN md5('Paper ' || doc_id || CASE WHEN body = '' THEN '' ELSE chr(10) || chr(10) || body END || chr(10) || chr(10) || 'Source' || chr(10) || chr(10) || 'It is in here.'
      || chr(10) || chr(10) || 'Table' || chr(10) || chr(10) || CASE WHEN coalesce(lang, '') = '' THEN '' ELSE lang || ' | ' END || n_chars) END AS h FROM d""",
)
def article_text(t: Tables) -> DataFrame:
    out = article_texts(t.documents.select("doc_id", F.expr(_XML).alias("xml")), "doc_id", "xml")
    return out.select("doc_id", "refusal", F.md5("text").alias("h"))


@query("alpha_ratio", "SELECT doc_id, round(length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / nullif(length(text), 0)::DOUBLE, 6) AS ratio FROM documents")
def alpha_ratio(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.round(F.try_divide(F.length(F.regexp_replace("text", "[^A-Za-z]", "")), F.length("text")), 6).alias("ratio"))


@query("canonical_text", "SELECT doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS h FROM documents")
def canonical_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(X.collapse(F.col("text"))).alias("h"))


@query("content_hash", "SELECT doc_id, sha256(text) AS h, substr(sha256(text), 1, 2) AS shard FROM documents")
def content_hash(t: Tables) -> DataFrame:
    h = F.sha2("text", 256)
    return t.documents.select("doc_id", h.alias("h"), F.substr(h, F.lit(1), F.lit(2)).alias("shard"))


@query(
    "source_texts",
    """WITH p AS (SELECT 'P' || page_id % 60 AS publication_id, page_id, html, sha256(html) AS h FROM pages WHERE html IS NOT NULL AND page_id % 60 <> 7), b AS (SELECT publication_id, arg_max(html, page_id) AS html, arg_max(h, page_id) AS h FROM p WHERE page_id % 7 <> 3 GROUP BY 1)
    SELECT DISTINCT 'p' || x.page_id % 60 AS publication_id, 'fulltext/' || substr(h, 1, 2) || '/' || h || '.html' AS path, md5(b.html) AS text_md5, CASE WHEN b.html IS NULL THEN 'no_asset' END AS refusal FROM pages x LEFT JOIN b ON b.publication_id = 'P' || x.page_id % 60""",
)
def source_texts(t: Tables) -> DataFrame:
    root = store.scratch(t._spark, "blobs")
    name = lambda prefix: F.concat(F.lit(prefix), (F.col("page_id") % 60).cast("string"))
    kept = B.store_blobs(t.pages.where("page_id % 60 <> 7").select("page_id", "html", F.lit("text/html").alias("kind")), "page_id", "html", "kind", root)
    state = F.when(F.col("page_id") % 7 == 3, "link_only").otherwise(B.STORED)
    assets = kept.select(name("P").alias("publication_id"), "path", "checksum", F.lit("text/html").alias("media_type"), state.alias("state"), F.col("page_id").alias("retrieved_at"))
    out = B.source_texts(t.pages.select(name("p").alias("publication_id")).distinct(), assets, root)
    return out.select("publication_id", "path", F.md5("text").alias("text_md5"), "refusal")


@query("classify_payload", "SELECT page_id, CASE WHEN length(html) < 100 THEN 'too_short' WHEN lower(substr(html, 1, 200)) LIKE '%<html%' THEN 'html' WHEN substr(html, 1, 4) = '%PDF' THEN 'pdf' ELSE 'unknown' END AS kind FROM pages")
def classify_payload(t: Tables) -> DataFrame:
    head = F.lower(F.substring("html", 1, 200))
    return t.pages.select("page_id", F.when(F.length("html") < 100, "too_short").when(head.contains("<html"), "html").when(F.col("html").startswith("%PDF"), "pdf").otherwise("unknown").alias("kind"))


@query(
    "coalesce_priority",
    "SELECT o_custkey, arg_min(o_orderkey, struct_pack(p := o_orderpriority, k := o_orderkey)) AS chosen FROM orders GROUP BY o_custkey",
)
def coalesce_priority(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.min(F.struct("o_orderpriority", "o_orderkey"))["o_orderkey"].alias("chosen"))


@query(
    "keyword_windows",
    """WITH p AS (SELECT doc_id, text, unnest(list_filter(range(1, length(text) + 1), lambda i: substr(text, i, 8) = ' License')) AS i FROM documents WHERE contains(text, ' License')),
    w AS (SELECT doc_id, i, trim(regexp_replace(substr(text, greatest(1, i - 40), 80), '\\s+', ' ', 'g')) AS win FROM p),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, substr(win, 1, 60) ORDER BY i) AS rn FROM w)
    SELECT doc_id, win FROM r WHERE rn = 1""",
)
def keyword_windows(t: Tables) -> DataFrame:
    d = t.documents.where(F.col("text").contains(" License"))
    p = d.select("doc_id", "text", F.explode(X.find_all(F.col("text"), F.lit(" License"))).alias("i"))
    w = p.select("doc_id", "i", X.collapse(F.substr(F.col("text"), F.greatest(F.lit(1), F.col("i") - 39), F.lit(80))).alias("win"))
    rn = F.row_number().over(Window.partitionBy("doc_id", F.substring("win", 1, 60)).orderBy("i"))
    return w.withColumn("rn", rn).where("rn = 1").select("doc_id", "win")


# ---------------------------------------------------------------- sequences

_D = "(SELECT doc_id, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS s FROM documents)"


def _sequences(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.regexp_replace(F.upper("text"), "[^ACGT]", "").alias("s"))


_CODONS = "regexp_extract_all(s, '...')"


#: The two tables' amino acids in the order T, C, A, G, read by place rather than by the functions' maps.
_AA1 = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
_AA3 = "FFLLSSSSYY**CCWWTTTTPPPPHHQQRRRRIIMMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
_PLACE = "16 * (strpos('TCAG', c[1]) - 1) + 4 * (strpos('TCAG', c[2]) - 1) + strpos('TCAG', c[3])"
_AMINO1, _AMINO3 = (f"substr('{aa}', {_PLACE}, 1)" for aa in (_AA1, _AA3))
_RECODED = "CASE WHEN c = 'ATA' THEN 'ATT' WHEN c IN ('CTA', 'CTC', 'CTG', 'CTT') THEN 'TTA' WHEN c = 'TGA' THEN 'TAA' WHEN c IN ('CGA', 'CGC') THEN 'AGA' ELSE c END"


@query("codons", f"SELECT doc_id, len({_CODONS}) AS n, array_to_string({_CODONS}[1:3], ',') AS head FROM {_D} x")
def codons(t: Tables) -> DataFrame:
    return _sequences(t).select("doc_id", Q.codons(F.col("s")).alias("c")).select("doc_id", F.size("c").cast("long").alias("n"), F.array_join(F.slice("c", 1, 3), ",").alias("head"))


@query("translate", f"SELECT doc_id, array_to_string(list_transform({_CODONS}, lambda c: {_AMINO3}), '') AS protein FROM {_D} x")
def translate(t: Tables) -> DataFrame:
    return _sequences(t).select("doc_id", Q.translate(F.col("s"), 3).alias("protein"))


@query("codon_diff", f"SELECT doc_id, len(list_filter({_CODONS}, lambda c: {_AMINO1} <> {_AMINO3})) AS differing FROM {_D} x")
def codon_diff(t: Tables) -> DataFrame:
    return _sequences(t).select("doc_id", F.size(Q.codon_diff(F.col("s"))).cast("long").alias("differing"))


@query("at_fraction", f"SELECT doc_id, round(length(regexp_replace(s, '[^AT]', '', 'g')) / nullif(length(s), 0)::DOUBLE, 6) AS at_share FROM {_D} x")
def at_fraction(t: Tables) -> DataFrame:
    return _sequences(t).select("doc_id", F.round(Q.at_fraction(F.col("s")), 6).alias("at_share"))


@query("recode", f"SELECT doc_id, array_to_string(list_transform({_CODONS}, lambda c: {_RECODED}), '') AS recoded FROM {_D} x")
def recode(t: Tables) -> DataFrame:
    return _sequences(t).select("doc_id", Q.recode(F.col("s"), "dual_safe").alias("recoded"))


@query("codon_compare", f"SELECT doc_id, len(list_filter({_CODONS}, lambda c: c <> {_RECODED})) AS changed FROM {_D} x")
def codon_compare(t: Tables) -> DataFrame:
    s = _sequences(t).withColumn("r", Q.recode(F.col("s"), "dual_safe"))
    pairs = F.zip_with(Q.codons(F.col("s")), Q.codons(F.col("r")), lambda a, b: a != b)
    return s.select("doc_id", F.size(F.filter(pairs, lambda x: x)).cast("long").alias("changed"))


@query("revcomp", f"SELECT doc_id, reverse(translate(s, 'ACGT', 'TGCA')) AS rc FROM {_D} x")
def revcomp(t: Tables) -> DataFrame:
    return _sequences(t).select("doc_id", Q.reverse_complement(F.col("s")).alias("rc"))


@query("splice", f"SELECT doc_id, substr(s, 1, 9) || substr(s, 16, 12) AS cds FROM {_D} x")
def splice(t: Tables) -> DataFrame:
    seg = lambda a, b: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"))
    return _sequences(t).select("doc_id", Q.splice(F.col("s"), F.array(seg(15, 27), seg(0, 9))).alias("cds"))


_PROTEIN = "array_to_string(list_transform(regexp_extract_all(s, '...'), lambda c: {}), '')"


@query(
    "peptide_compare",
    f"""WITH p AS (SELECT doc_id, {_PROTEIN.format(_AMINO1)} AS a, {_PROTEIN.format(_AMINO3)} AS b FROM {_D} x)
    SELECT doc_id, CASE WHEN a = b THEN 'exact' WHEN contains(substr(a, 1, least(length(a), length(b)) - 1), '*') THEN 'internal_stop' ELSE 'mismatch' END AS verdict FROM p""",
)
def peptide_compare(t: Tables) -> DataFrame:
    p = _sequences(t).select("doc_id", Q.translate(F.col("s"), 1).alias("a"), Q.translate(F.col("s"), 3).alias("b"))
    return p.select("doc_id", Q.peptide_verdict(F.col("a"), F.col("b")).alias("verdict"))


@query(
    "qc_identity",
    f"""WITH p AS (SELECT doc_id, {_PROTEIN.format(_AMINO1)} AS a, {_PROTEIN.format(_AMINO3)} AS b FROM {_D} x)
    SELECT count(*) AS n, count(*) FILTER (a = b) AS identical, count(*) FILTER (a = b) / count(*)::DOUBLE >= 0.995 AS passed FROM p""",
)
def qc_identity(t: Tables) -> DataFrame:
    p = _sequences(t).select((Q.translate(F.col("s"), 1) == Q.translate(F.col("s"), 3)).alias("same"))
    return p.agg(F.count("*").alias("n"), F.count_if("same").alias("identical")).withColumn("passed", F.col("identical") / F.col("n") >= 0.995)


@query(
    "mito_translation",
    f"""WITH p AS (SELECT doc_id, split_part({_PROTEIN.format(_AMINO1)}, '*', 1) AS a, split_part({_PROTEIN.format(_AMINO3)}, '*', 1) AS b FROM {_D} x)
    SELECT doc_id, doc_id % 2 = 0 OR a = b AS matches_table3, doc_id % 2 = 1 OR a = b AS matches_table1 FROM p""",
)
def mito_translation(t: Tables) -> DataFrame:
    # every second reference protein was made under the other table
    s = _sequences(t).withColumn("reference", F.when(F.col("doc_id") % 2 == 0, Q.translate(F.col("s"), 3, to_stop=True)).otherwise(Q.translate(F.col("s"), 1, to_stop=True)))
    return s.select("doc_id", Q.verify_translation(F.col("s"), F.col("reference")).alias("v")).select("doc_id", "v.matches_table3", "v.matches_table1")


@query(
    "insdc_location",
    "SELECT p_partkey, p_size - 1 AS start_pos, p_size + 300 AS end_pos, CASE WHEN p_partkey % 2 = 0 THEN -1 ELSE 1 END AS strand, 3 AS segments, p_partkey % 3 = 0 AS open_start FROM part",
)
def insdc_location(t: Tables) -> DataFrame:
    n = lambda by: (F.col("p_size") + by).cast("string")
    spans = F.concat(F.lit("join("), F.when(F.col("p_partkey") % 3 == 0, "<").otherwise(""), n(0), F.lit(".."), n(90), F.lit(",J00194.1:1..99,"), n(200), F.lit("..>"), n(300), F.lit(")"))
    said = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("complement("), spans, F.lit(")"))).otherwise(spans)
    l = t.part.select("p_partkey", location(said).alias("l"))  # noqa: E741
    return l.select("p_partkey", F.col("l.start").alias("start_pos"), F.col("l.end").alias("end_pos"), "l.strand", F.size("l.segments").alias("segments"), F.col("l.segments")[0]["open_start"].alias("open_start"))


_SOURCES = [("europe", "CASE WHEN p_size % 2 = 0 THEN concat('e', p_partkey) END"), ("unpaid", "CASE WHEN p_size % 3 = 0 THEN concat('u', p_partkey) END"), ("archive", "CASE WHEN p_size % 5 = 0 THEN concat('a', p_partkey) END")]


@query("open_access", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'europe' WHEN p_size % 3 = 0 THEN 'unpaid' WHEN p_size % 5 = 0 THEN 'archive' ELSE 'none' END AS source, CASE WHEN p_size % 2 = 0 THEN 'e' || p_partkey WHEN p_size % 3 = 0 THEN 'u' || p_partkey WHEN p_size % 5 = 0 THEN 'a' || p_partkey END AS url FROM part")
def open_access(t: Tables) -> DataFrame:
    return first_hit([(name, t.part.select("p_partkey", F.expr(sql).alias("url"))) for name, sql in _SOURCES], "p_partkey", F.col("url").isNotNull())


@query(
    "search_pages",
    "SELECT 'id' || (k * 7) AS id, min(i) AS place FROM (SELECT event_id % 400 AS k, event_id AS i FROM events) x GROUP BY k",
)
def search_pages(t: Tables) -> DataFrame:
    # answers of ten records a page, in which records come again
    page = F.floor(F.col("event_id") / 10)
    one = F.struct(F.col("event_id").alias("i"), F.concat(F.lit("id"), (F.col("event_id") % 400 * 7).cast("string")).alias("id"))
    p = t.events.groupBy(page.alias("page")).agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["id"]).alias("ids"))
    body = F.to_json(F.struct(F.struct((F.col("page") * 10).cast("string").alias("retstart"), F.col("ids").alias("idlist")).alias("esearchresult")))
    return search_ids(p.select(body.alias("body")))


@query("series_records", "SELECT 'GSE' || p_partkey AS accession, 'Study of ' || p_name AS title, p_size AS n_samples, 2 AS papers FROM part WHERE p_partkey % 3 <> 0")
def series_records(t: Tables) -> DataFrame:
    text = lambda c: F.col(c).cast("string")
    record = F.struct(F.concat(F.when(F.col("p_partkey") % 3 == 0, "GPL").otherwise("GSE"), text("p_partkey")).alias("accession"), F.concat(F.lit("Study of "), "p_name").alias("title"), F.lit("yeast").alias("taxon"), F.col("p_size").alias("n_samples"), F.array(F.lit("1"), F.lit("2")).alias("pubmedids"))
    body = F.concat(F.lit('{"result":{"uids":["1"],"'), text("p_partkey"), F.lit('":'), F.to_json(record), F.lit("}}"))
    return series(t.part.select(body.alias("body"))).select("accession", "title", "n_samples", F.size("pubmed_ids").alias("papers"))


@query("go_answers", "SELECT p_partkey AS gene, 'GO:' || p_size AS term, 'IDA' AS evidence, p_size % 2 = 0 AS negated FROM part")
def go_answers(t: Tables) -> DataFrame:
    one = F.struct(F.concat(F.lit("GO:"), F.col("p_size").cast("string")).alias("goId"), F.lit("IDA").alias("goEvidence"), F.when(F.col("p_size") % 2 == 0, "NOT|part_of").otherwise("part_of").alias("qualifier"))
    body = F.when(F.col("p_partkey") % 2 == 0, F.to_json(F.struct(F.array(one).alias("results")))).otherwise(F.to_json(F.array(one)))
    return go_annotations(t.part.select(F.col("p_partkey").alias("gene"), body.alias("body")), "gene").select("gene", "term", "evidence", "negated")
