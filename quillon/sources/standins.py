"""Stand-in entities: projections of the supplied tables onto the data model's entities.

The SQL is read alike by Spark and DuckDB, so a query and its oracle start from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS: dict[str, str] = {
    "v_evidence_item": """
        SELECT event_id AS evidence_id, CAST(floor(event_id / 3.0) AS BIGINT) AS assertion_id, user_id AS publication_id,
          CASE event_type WHEN 'purchase' THEN 'direct_perturbation' WHEN 'signup' THEN 'direct_biochemical'
            WHEN 'view' THEN 'correlative_omics' WHEN 'click' THEN 'comparative_genomic'
            ELSE CASE WHEN event_id % 2 = 0 THEN 'computational_model' ELSE 'literature_assertion' END END AS evidence_type,
          CASE WHEN value < 30 THEN 'decreases' WHEN value < 200 THEN 'increases' END AS direction,
          CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 4 AS independent_group,
          CASE WHEN event_id % 7 = 0 OR CAST(floor(event_id / 3.0) AS BIGINT) % 23 = 0 THEN 'superseded' ELSE 'active' END AS status
        FROM events""",
    "v_assertion": """
        SELECT assertion_id, CASE WHEN assertion_id % 31 = 0 THEN 'L3' END AS level_override, assertion_id % 17 = 0 AS open_conflict
        FROM (SELECT DISTINCT assertion_id FROM v_evidence_item) x""",
    "v_measurement": """
        SELECT l_orderkey * 10 + l_linenumber AS measurement_id, l_quantity AS value, l_returnflag AS quantity_kind, l_linestatus AS unit,
          l_suppkey AS strain_id, l_partkey AS product_id, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_orderkey END AS sample_id,
          l_extendedprice AS price, l_discount AS discount, l_tax AS tax, l_orderkey AS experiment_id, l_linenumber AS line
        FROM lineitem""",
    "v_context": """
        SELECT p_partkey AS context_id, CASE WHEN p_size < 5 THEN 'unknown' ELSE p_type END AS aeration, p_brand AS feedstock,
          p_size AS temperature_c, p_retailprice AS sugar, CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_size < 25 THEN 'batch' ELSE 'fed' END AS carbon_regime
        FROM part""",
    "v_matrix": """
        SELECT l_partkey AS gene, CAST(l_suppkey % 6 AS INT) AS sample, sum(l_quantity) AS n, CASE WHEN l_suppkey % 6 < 3 THEN 'ref' ELSE 'trt' END AS grp
        FROM lineitem GROUP BY l_partkey, l_suppkey % 6""",
    "v_feature": """
        SELECT event_id AS feature_id, CAST(user_id % 17 AS INT) AS seqid, event_id * 37 % 1000000 AS start_pos,
          event_id * 37 % 1000000 + CAST(floor(value) AS BIGINT) AS end_pos, CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS strand, event_type AS biotype
        FROM events""",
    "v_document": """
        SELECT d.doc_id, d.text, d.lang, d.source, CAST(1985 + d.doc_id % 40 AS INT) AS year, l.quality, l.toxic
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "v_entity": """
        SELECT 'publication' AS kind, CAST(doc_id AS BIGINT) AS id, concat('Paper ', doc_id) AS name, coalesce(text, '') AS body, CAST(1985 + doc_id % 40 AS INT) AS year, CASE WHEN doc_id % 3 = 0 THEN 1.0E0 ELSE 0.2E0 END AS evidence FROM documents
        UNION ALL SELECT 'strain', CAST(s_suppkey AS BIGINT), s_name, concat('nation ', s_nationkey), CAST(2000 AS INT), 0.4E0 FROM supplier
        UNION ALL SELECT 'product', CAST(p_partkey AS BIGINT), p_name, concat(p_brand, ' ', p_type, ' size ', p_size), CAST(1990 + p_size % 30 AS INT), CASE WHEN p_size > 25 THEN 0.8E0 ELSE 0.0E0 END FROM part
        UNION ALL SELECT 'organism', CAST(n_nationkey AS BIGINT), n_name, concat('region ', n_regionkey), CAST(NULL AS INT), 0.0E0 FROM nation
        UNION ALL SELECT 'laboratory', CAST(c_custkey AS BIGINT), c_name, concat(c_mktsegment, ' nation ', c_nationkey), CAST(2010 AS INT), 0.1E0 FROM customer
        UNION ALL SELECT 'pathway', CAST(r_regionkey AS BIGINT), r_name, concat('region ', r_regionkey, ' brand 1'), CAST(2020 AS INT), 0.6E0 FROM region
        UNION ALL SELECT 'protocol', CAST(item_id AS BIGINT), concat('Protocol ', item_id), text, CAST(2015 AS INT), 0.3E0 FROM benchmark
        UNION ALL SELECT 'dataset', CAST(page_id AS BIGINT), url, '', CAST(2005 AS INT), 0.2E0 FROM pages""",
    "v_participant": """
        SELECT l_orderkey AS reaction_id, l_partkey AS metabolite_id, CASE WHEN l_returnflag = 'A' THEN 'substrate' ELSE 'product' END AS role,
          l_quantity AS coefficient, l_linenumber AS line
        FROM lineitem""",
    "v_queue": """
        SELECT o_orderkey AS task_id, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'accepted' ELSE 'in_progress' END AS status,
          CAST(substr(o_orderpriority, 1, 1) AS INT) AS priority, o_orderdate AS created_at, o_orderdate + INTERVAL 30 DAY AS lease_expires_at,
          o_custkey AS extraction_id, CAST(o_orderkey % 5 AS INT) AS attempts
        FROM orders""",
    "v_route_part": """
        SELECT min(p_partkey) AS part_id, CAST(p_size % 18 % 6 AS INT) AS step_role, min(p_brand) AS compartment, min(p_type) AS enzyme,
          CASE min(p_partkey) % 5 WHEN 0 THEN 'NADH' WHEN 1 THEN 'NADPH' WHEN 2 THEN 'either' ELSE 'NA' END AS cofactor
        FROM part GROUP BY p_size % 18""",
    "v_metabolite": """
        SELECT p_partkey AS metabolite_id, p_name AS name, CASE WHEN p_partkey % 10 < 4 THEN 21 WHEN p_partkey % 10 < 6 THEN 10 ELSE p_size END AS carbons,
          CASE WHEN p_partkey % 10 < 2 THEN 'nad' WHEN p_partkey % 10 < 4 THEN 'nadp' WHEN p_partkey % 10 = 9 AND p_size > 45 THEN 'fad' END AS pair,
          CASE WHEN p_partkey % 10 IN (0, 2) OR p_partkey % 10 = 9 AND p_size > 45 THEN 'reduced' WHEN p_partkey % 10 IN (1, 3) THEN 'oxidized' END AS redox,
          CASE p_partkey % 10 WHEN 4 THEN 'charged' WHEN 5 THEN 'discharged' END AS adenylate
        FROM part""",
    "v_reaction": """
        SELECT o_orderkey AS reaction_id, CAST(floor(o_orderkey / 3.0) AS BIGINT) AS pathway_id, CAST((o_orderkey - CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END) % 6 AS INT) AS step_role, concat('G', o_orderkey % 5) AS gene, o_orderkey % 17 = 0 AS transfers FROM orders""",
    "v_reaction_part": """
        SELECT l_orderkey AS reaction_id, l_partkey AS metabolite_id, CASE WHEN l_orderkey % 23 = 5 AND l_linenumber = 1 THEN 'cofactor' ELSE 'substrate' END AS role, CAST(l_linenumber AS DOUBLE) AS coefficient FROM lineitem
        UNION ALL SELECT l_orderkey, CASE WHEN l_orderkey % 17 = 0 AND l_partkey % 10 = 0 THEN l_partkey + 2 WHEN l_partkey % 10 IN (0, 2, 4) THEN l_partkey + 1 WHEN l_partkey % 10 IN (1, 3, 5) THEN l_partkey - 1 ELSE l_partkey END,
          'product', CAST(l_linenumber + CASE WHEN l_orderkey % 13 = 5 AND l_linenumber = 1 THEN 1 ELSE 0 END AS DOUBLE) FROM lineitem WHERE NOT (l_orderkey % 11 = 3 AND l_linenumber = 2)""",
    "v_route_step": """
        SELECT x.pathway_id * 3 + p.strategy AS route_id, x.pathway_id, x.step_role, (x.pathway_id * 6 + x.step_role) % 97 AS part_id, CASE WHEN p.strategy = 1 OR p.strategy = 2 AND x.step_role < 3 THEN 'matrix' ELSE 'cytosol' END AS compartment,
          CASE (x.pathway_id * 7 + x.step_role * 5 + p.strategy) % 23 WHEN 0 THEN 'unknown' WHEN 1 THEN 'either' WHEN 2 THEN 'NADPH' WHEN 3 THEN 'NADH' ELSE CASE WHEN x.nad = 0 AND x.nadp = 0 THEN 'NA' WHEN x.nad >= x.nadp THEN 'NADH' ELSE 'NADPH' END END AS cofactor,
          concat('g', (x.pathway_id + x.step_role) % 5) AS gene
        FROM (SELECT r.pathway_id, r.step_role, count(CASE WHEN l.l_partkey % 10 IN (0, 1) THEN 1 END) AS nad, count(CASE WHEN l.l_partkey % 10 IN (2, 3) THEN 1 END) AS nadp FROM v_reaction r JOIN lineitem l ON l.l_orderkey = r.reaction_id GROUP BY r.pathway_id, r.step_role) x
          CROSS JOIN (SELECT DISTINCT CAST(r_regionkey % 3 AS INT) AS strategy FROM region) p""",
    "v_citable": """
        SELECT 'publication' AS kind, CAST(doc_id AS BIGINT) AS id, CAST(NULL AS BIGINT) AS publication_id, CAST(NULL AS BIGINT) AS processing_run_id, CAST(NULL AS BIGINT) AS dataset_id FROM documents
        UNION ALL SELECT 'span', page_id, CASE WHEN page_id % 11 = 0 THEN NULL WHEN page_id % 13 = 0 THEN -page_id ELSE page_id % 97 END, NULL, NULL FROM pages
        UNION ALL SELECT 'extraction', o_orderkey, CASE WHEN o_orderkey % 37 = 0 THEN NULL WHEN o_orderkey % 41 = 0 THEN -o_orderkey ELSE o_orderkey % 97 END, NULL, NULL FROM orders
        UNION ALL SELECT 'analysis_result', s_suppkey, NULL, CASE WHEN s_suppkey % 9 = 1 THEN NULL ELSE s_nationkey + CASE WHEN s_suppkey % 8 = 2 THEN 100 ELSE 0 END END, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_suppkey % 7 END FROM supplier
        UNION ALL SELECT 'processing_run', n_nationkey, NULL, NULL, NULL FROM nation
        UNION ALL SELECT 'dataset', r_regionkey, NULL, NULL, NULL FROM region
        UNION ALL SELECT 'measurement', p_partkey, NULL, NULL, NULL FROM part
        UNION ALL SELECT 'strain', c_custkey, NULL, NULL, NULL FROM customer""",
    "v_cited": """
        SELECT event_id AS evidence_id, CAST(floor(event_id / 3.0) AS BIGINT) AS assertion_id, CASE WHEN event_id % 7 = 0 OR CAST(floor(event_id / 3.0) AS BIGINT) % 23 = 0 THEN 'superseded' ELSE 'active' END AS status,
          CASE WHEN event_id % 29 = 5 THEN -event_id WHEN event_id % 6 IN (0, 1) THEN event_id % 97 END AS publication_id, CASE WHEN event_id % 6 IN (1, 2) THEN event_id % 60 END AS span_id,
          CASE WHEN event_id % 6 = 3 THEN event_id % 1700 END AS extraction_id, CASE WHEN event_id % 5 = 0 THEN event_id % 210 END AS measurement_id, CASE WHEN event_id % 12 = 4 THEN event_id % 13 END AS analysis_result_id,
          CASE WHEN event_id % 12 IN (4, 5) THEN event_id % 27 END AS processing_run_id, CASE WHEN event_id % 4 = 0 THEN event_id % 140 END AS strain_id
        FROM events""",
    "v_statement": """
        SELECT assertion_id, CASE WHEN assertion_id % 19 = 0 THEN 'retired' ELSE 'active' END AS status, CASE assertion_id % 5 WHEN 0 THEN 'paper' WHEN 1 THEN 'gadget' ELSE 'strain' END AS subject_type, assertion_id % 150 AS subject_id,
          CASE assertion_id % 3 WHEN 0 THEN 'literal' ELSE 'run' END AS object_type, CASE WHEN assertion_id % 3 = 0 OR assertion_id % 8 = 0 THEN NULL ELSE assertion_id % 26 END AS object_id
        FROM (SELECT DISTINCT CAST(floor(event_id / 3.0) AS BIGINT) AS assertion_id FROM events) x""",
    "v_curation": """
        SELECT CAST(floor(event_id / 3.0) AS BIGINT) AS target_id, CASE WHEN event_id % 5 < 2 THEN '  ' WHEN event_id % 5 = 2 THEN NULL ELSE event_type END AS curator FROM events WHERE event_id % 4 = 1 OR event_id % 7 = 3""",
    "v_catalog": """
        SELECT k AS part_id, CAST(k % 6 AS INT) AS step_role, concat('gen', CASE WHEN k < 42 THEN k ELSE k % 6 END) AS gene, CASE WHEN k >= 48 AND k % 2 = 1 THEN concat('w', k % 6, 'd') WHEN k >= 42 THEN concat('v', k % 6, 'd') END AS designation,
          CASE k % 5 WHEN 0 THEN 'Aus bonus' WHEN 1 THEN 'Aus minor' ELSE 'Cetus magnus' END AS organism
        FROM (SELECT DISTINCT p_partkey % 54 AS k FROM part) x""",
    "v_config": """
        SELECT o_orderkey AS config_id, CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 11 = 1 THEN 'Z' WHEN o_orderkey % 3 = 0 THEN 'A' WHEN o_orderkey % 3 = 1 THEN 'B' ELSE 'C' END AS strategy,
          CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_custkey END AS host, CASE WHEN o_custkey % 7 = 0 THEN 'other' ELSE 'yeast' END AS host_organism
        FROM orders""",
    "v_config_entry": """
        SELECT l_orderkey AS config_id,
          CASE WHEN l_partkey % 40 = 0 THEN 'putative oxidase' WHEN l_partkey % 20 = 1 THEN concat('Step', (l_linenumber - 1) % 5, ' enzyme from ', CASE l_suppkey % 3 WHEN 0 THEN 'Aus bonus' WHEN 1 THEN 'A. minor' ELSE 'Dux rex' END)
            WHEN l_partkey % 40 = 2 THEN 'step1 and step2 from Aus bonus' WHEN l_partkey % 40 = 3 THEN 'Stepfamily genes from Aus bonus' WHEN l_partkey % 40 = 4 THEN 'GenZ'
            ELSE concat('Gen', (l_linenumber - 1) % 6 + CASE WHEN l_partkey % 2 = 0 THEN 0 ELSE 6 END, CASE WHEN l_partkey % 9 = 0 THEN concat(' V', (l_linenumber - 1) % 6, '-D') WHEN l_partkey % 9 = 1 THEN ' W1D' ELSE '' END, ' strain ', l_suppkey) END AS entry
        FROM lineitem WHERE l_orderkey % 9 <> 4""",
    "v_config_route": """
        SELECT c.c_custkey AS route_id, CASE c.c_custkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS strategy, r.role, CASE WHEN c.c_custkey % 10 = 0 THEN r.role + 42
          ELSE r.role + 6 * (CAST(floor(c.c_custkey / CASE r.role WHEN 0 THEN 1.0 WHEN 1 THEN 2.0 WHEN 2 THEN 4.0 WHEN 3 THEN 8.0 ELSE 16.0 END) AS BIGINT) % 2) END AS part_id
        FROM customer c CROSS JOIN (SELECT DISTINCT CAST(p_partkey % 5 AS INT) AS role FROM part) r""",
    "v_facet": """
        SELECT user_id % 40 AS publication_id, event_id AS task_id, CASE event_id % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'edited' ELSE 'accepted' END AS status, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 80 * 10 END AS span_start,
          CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 80 * 10 + 7 END AS span_end, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE concat('S', event_id % 6) END AS strain, event_type AS facet
        FROM events""",
    "v_paper": """
        SELECT doc_id, concat('Paper ', doc_id, chr(10), 'Background', chr(10), 'We ask about ', source, '.', chr(10), 'Results:', chr(10), 'It holds.', chr(10),
          CASE WHEN doc_id % 2 = 0 THEN concat('1. Introduction', chr(10)) ELSE '' END, text, chr(10),
          CASE WHEN doc_id % 5 = 0 THEN concat('Conclusions', chr(10), 'None.') ELSE concat('2.1 Materials and Methods', chr(10), 'As before.', chr(10), '**Results and Discussion**', chr(10), lang) END) AS text
        FROM documents WHERE text IS NOT NULL""",
    "v_flag": """
        SELECT s_suppkey AS target_id, 'quarantine' AS severity, CASE WHEN s_suppkey % 5 = 0 THEN 'resolved' ELSE 'active' END AS status, s_acctbal AS statistic
        FROM supplier WHERE s_acctbal < 0""",
    "v_contrast_member": """
        SELECT l_orderkey AS experiment_id, CASE l_orderkey % 3 WHEN 0 THEN 'genotype' WHEN 1 THEN 'time' ELSE 'carbon_source' END AS axis, CASE WHEN l_orderkey % 17 = 4 THEN NULL ELSE l_orderkey % 5 END AS reference_context,
          CASE WHEN l_orderkey % 19 = 6 THEN NULL WHEN l_orderkey % 11 = 1 OR l_orderkey % 3 = 0 AND l_orderkey % 7 <> 2 THEN l_orderkey % 5 ELSE (l_orderkey + 1) % 5 END AS treatment_context,
          CASE WHEN l_linenumber % 2 = 1 THEN 'reference' ELSE 'treatment' END AS side, l_linenumber AS line, l_suppkey AS sample_id
        FROM lineitem""",
    "v_sample": """
        SELECT s_suppkey AS sample_id, CASE WHEN s_suppkey % 10 = 3 THEN NULL ELSE s_nationkey % 5 END AS context_id, CASE WHEN s_suppkey % 4 = 1 THEN NULL ELSE s_nationkey % 2 END AS strain_id
        FROM supplier WHERE s_suppkey % 30 <> 8""",
    "v_run": """
        SELECT s_suppkey AS sample_id, CASE WHEN s_suppkey % 12 = 5 THEN 'SRP2' ELSE 'SRP1' END AS study, CASE WHEN s_nationkey = 9 THEN 'Aus minor' ELSE 'Aus bonus' END AS organism FROM supplier""",
    "v_strain": """
        SELECT s_suppkey AS strain_id, s_name AS canonical_name, s_nationkey AS organism_id, s_acctbal AS score FROM supplier""",
    "v_product": """
        SELECT p_partkey AS product_id, p_name AS name, p_brand AS tier, p_retailprice AS ceiling, p_size AS carbons, p_type AS family FROM part""",
}


def names_in(sql: str) -> list[str]:
    """Tables and stand-ins that a text of SQL names, in the order of VIEWS and TABLES."""
    words = set(re.findall(r"\b[a-z_]+\b", sql))
    return [n for n in [*VIEWS, *TABLES] if n in words]


def with_views(sql: str) -> str:
    """DuckDB SQL with the stand-ins it needs as common table expressions."""
    need: list[str] = []

    def add(text: str) -> None:
        for n in names_in(text):
            if n in VIEWS and n not in need:
                add(VIEWS[n])
                need.append(n)

    add(sql)
    if not need:
        return sql
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in need)
    body = sql.strip()
    if m := re.match(r"WITH\s+(RECURSIVE\s+)?", body):
        return f"WITH {m[1] or ''}{ctes},\n{body[m.end() :]}"
    return f"WITH {ctes}\n{body}"


class Tables:
    """Tables and stand-ins of one directory as DataFrames: Tables(spark, sf_dir).lineitem, .v_measurement."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self._spark.read.parquet(f"{self._dir}/{name}.parquet")
        if name not in VIEWS:
            raise AttributeError(name)
        text, need = VIEWS[name], names_in(VIEWS[name])
        for n in need:
            text = re.sub(rf"\b(FROM|JOIN) {n}\b", rf"\1 {{{n}}}", text)
        return self._spark.sql(text, **{n: getattr(self, n) for n in need})
