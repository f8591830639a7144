"""Lexical search: postings, BM25, ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators import search as L
from quillon.registry import query
from quillon.sources import store
from quillon.sources.standins import Tables

_TK = "unnest(regexp_extract_all(lower(text), '[a-z0-9]+'))"
_NAME = "array_to_string(regexp_extract_all(text, '[A-Za-z0-9]+')[1:8], ' ')"


def _documents(t: Tables) -> DataFrame:
    """Documents as entities, with their first eight words as a name."""
    words = F.regexp_extract_all("text", F.lit("[A-Za-z0-9]+"), F.lit(0))
    evidence = F.when(F.col("quality") == 1, 1.0).when(F.col("quality") == 0, 0.2).otherwise(0.0)
    return t.v_document.select(F.lit("publication").alias("kind"), F.col("doc_id").alias("id"), F.array_join(F.slice(words, 1, 8), " ").alias("name"), F.col("text").alias("body"), "year", evidence.alias("evidence"))


def _index(t: Tables, name: str, entities: DataFrame, *sources: DataFrame) -> str:
    """Path of a fresh index of entities, built unless it is there."""
    path = store.scratch(t._spark, f"index-{name}-{t._dir.strip('/').replace('/', '-')}")
    L.ensure_index(t._spark, entities, path, "-".join(map(store.fingerprint, sources)))
    return path


@query("index_postings", f"SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, {_TK} AS term FROM documents) x GROUP BY term, doc_id")
def index_postings(t: Tables) -> DataFrame:
    return L.postings(t.documents, "doc_id", {"text": 1.0}).select("term", "doc_id", F.col("text").cast("long").alias("tf"))


@query("index_doclen", "SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS terms FROM documents")
def index_doclen(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.size(L.terms("text")).cast("long").alias("terms"))


_BM25 = f"""d AS (SELECT doc_id, {_NAME} AS name, text AS body FROM documents),
    tk AS (SELECT doc_id, unnest(regexp_extract_all(lower(name), '[a-z0-9]+')) AS term, 10.0::DOUBLE AS w FROM d UNION ALL SELECT doc_id, unnest(regexp_extract_all(lower(body), '[a-z0-9]+')), 1.0 FROM d),
    l AS (SELECT doc_id, count(*) AS len FROM tk GROUP BY doc_id), n AS (SELECT (SELECT count(*) FROM d) AS n, avg(len) AS av FROM l),
    f AS (SELECT doc_id, term, sum(w) AS f FROM tk WHERE term IN ('license', 'stupid') GROUP BY doc_id, term),
    i AS (SELECT term, greatest(1e-6, ln(((SELECT n FROM n) - count(*) + 0.5) / (count(*) + 0.5))) AS idf FROM f GROUP BY term),
    b AS (SELECT f.doc_id, sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / av))) AS score FROM f JOIN i ON i.term = f.term JOIN l ON l.doc_id = f.doc_id, n GROUP BY f.doc_id)"""


@query("bm25", f"WITH {_BM25} SELECT doc_id, round(score, 6) AS score FROM b")
def bm25(t: Tables) -> DataFrame:
    path = _index(t, "documents", _documents(t), t.documents, t.labels)
    return L.bm25(t._spark, path, [["license"], ["stupid"]], every=False).select(F.col("id").alias("doc_id"), F.round("text", 6).alias("score"))


@query(
    "lexical_rank",
    f"""WITH {_BM25}, m AS (SELECT b.doc_id, CASE WHEN max(score) OVER () = min(score) OVER () THEN 1.0 ELSE (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) END AS txt,
      CASE d.quality WHEN 1 THEN 1.0 WHEN 0 THEN 0.2 ELSE 0.0 END AS ev, greatest(0.0, least(1.0, (d.year - 1990) / 30.0)) AS rec FROM b JOIN v_document d ON d.doc_id = b.doc_id)
    SELECT doc_id, round((txt + 7.0 * ev + 0.25 * rec)::DOUBLE, 6) AS score FROM m ORDER BY score DESC, doc_id LIMIT 20""",
)
def lexical_rank(t: Tables) -> DataFrame:
    path = _index(t, "documents", _documents(t), t.documents, t.labels)
    hits = L.bm25(t._spark, path, [["license"], ["stupid"]], every=False)
    return L.ranked(hits, 20).select(F.col("id").alias("doc_id"), "score")


@query(
    "search_entities",
    """WITH g AS (SELECT kind, id, year, evidence, ' ' || array_to_string(regexp_extract_all(lower(name), '[a-z0-9]+'), ' ') || ' ' AS n, ' ' || array_to_string(regexp_extract_all(lower(body), '[a-z0-9]+'), ' ') || ' ' AS b,
      len(regexp_extract_all(lower(name), '[a-z0-9]+')) + len(regexp_extract_all(lower(body), '[a-z0-9]+')) AS len FROM v_entity),
    p AS (SELECT * FROM (VALUES (0, 'brand'), (0, 'apache license'), (0, 'nation'), (1, '1'), (1, 'version 2')) p(grp, phrase)),
    f AS (SELECT g.*, p.grp, p.phrase, 10.0::DOUBLE * (len(string_split(n, ' ' || phrase || ' ')) - 1) + len(string_split(replace(b, ' ', '  '), ' ' || replace(phrase, ' ', '  ') || ' ')) - 1 AS tf FROM g, p),
    h AS (SELECT *, count(*) OVER (PARTITION BY phrase) AS df FROM f WHERE tf > 0),
    s AS (SELECT kind, id, year, evidence, sum(greatest(1e-6, ln(((SELECT count(*) FROM g) - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / (SELECT avg(len) FROM g WHERE len > 0)))) AS text
      FROM h GROUP BY ALL HAVING count(DISTINCT grp) = 2),
    m AS (SELECT *, CASE WHEN max(text) OVER () = min(text) OVER () THEN 1.0 ELSE (text - min(text) OVER ()) / (max(text) OVER () - min(text) OVER ()) END AS txt FROM s)
    SELECT kind, id, round((txt + 7.0 * evidence + 0.25 * greatest(0.0, least(1.0, (year - 1990) / 30.0)))::DOUBLE, 6) AS score FROM m ORDER BY score DESC, kind, id LIMIT 25""",
)
def search_entities(t: Tables) -> DataFrame:
    path = _index(t, "entities", t.v_entity, t.documents, t.supplier, t.part, t.nation, t.customer, t.region, t.benchmark, t.pages)
    groups = {"brand": ["apache license", "nation"], "1": ["version 2"]}
    return L.search(t._spark, path, list(groups), groups, limit=25).select("kind", "id", "score")


@query("index_report", "SELECT kind, count(*) AS indexed, count(*) AS present, 'fresh' AS status FROM v_entity GROUP BY kind")
def index_report(t: Tables) -> DataFrame:
    sources = (t.documents, t.supplier, t.part, t.nation, t.customer, t.region, t.benchmark, t.pages)
    path = _index(t, "entities", t.v_entity, *sources)
    return L.index_report(t._spark, t.v_entity, path, "-".join(map(store.fingerprint, sources)))


@query("match_phrase_and", "SELECT doc_id FROM (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') || ' ' AS t FROM documents) x WHERE contains(t, ' apache license ') AND (contains(t, ' version ') OR contains(t, ' edition '))")
def match_phrase_and(t: Tables) -> DataFrame:
    return t.documents.where(L.match("text", [["apache license"], ["version", "edition"]])).select("doc_id")


@query("synonym_pairs", "SELECT a.n_name AS name, b.n_name AS synonym FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name <> b.n_name")
def synonym_pairs(t: Tables) -> DataFrame:
    return L.synonyms(t.nation, "n_regionkey", "n_name")


@query("cross_search", "SELECT 'product' AS kind, product_id::BIGINT AS id FROM (SELECT product_id FROM v_product WHERE name ILIKE '%1%' ORDER BY product_id LIMIT 10) x UNION ALL SELECT 'strain', strain_id FROM (SELECT strain_id FROM v_strain WHERE canonical_name ILIKE '%1%' ORDER BY strain_id LIMIT 10) y")
def cross_search(t: Tables) -> DataFrame:
    from quillon.operators.relational import contains_any

    p = t.v_product.where(contains_any("1", "name")).orderBy("product_id").limit(10).select(F.lit("product").alias("kind"), F.col("product_id").alias("id"))
    return p.union(t.v_strain.where(contains_any("1", "canonical_name")).orderBy("strain_id").limit(10).select(F.lit("strain"), "strain_id"))
