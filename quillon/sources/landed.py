"""Payloads of web interfaces that were landed as files: paged searches, summaries, series, annotation answers.

Fetching is left to whatever lands the files; `pages` plans what to fetch, so the same plan serves any transport.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SEARCH = "esearchresult struct<count:string,retstart:string,idlist:array<string>>"


def pages(spark: SparkSession, total: int, size: int = 200, most: int | None = None) -> DataFrame:
    """(retstart, retmax) of the pages that hold a search's records, one row a request."""
    wanted = total if most is None else min(total, most)
    return spark.range(0, wanted, size).select(F.col("id").alias("retstart"), F.least(F.lit(size), F.lit(wanted) - F.col("id")).alias("retmax"))


def fetch(requests: DataFrame, transport: Callable[[dict], str], retries: int = 3) -> DataFrame:
    """requests with body: a transport's answer to each row, on the executors; a row that fails `retries` times keeps the error.

    The transport is a plain function from a row to a text, so tests and landings plug in their own.
    """
    columns = requests.columns

    def run(batches):
        for pdf in batches:
            bodies, errors = [], []
            for row in pdf[columns].to_dict("records"):
                body, error = None, None
                for _ in range(retries):
                    try:
                        body, error = transport(row), None
                        break
                    except OSError as e:
                        error = str(e)
                bodies.append(body)
                errors.append(error)
            yield pdf.assign(body=bodies, error=errors)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema)
    return requests.mapInPandas(run, f"{fields}, body string, error string")


def search_ids(answers: DataFrame, body: str = "body") -> DataFrame:
    """(id, place) of the records that search pages name, each once, at its first place."""
    a = answers.select(F.from_json(body, _SEARCH)["esearchresult"].alias("r")).where("r IS NOT NULL")
    ids = a.select(F.posexplode("r.idlist").alias("i", "id"), F.col("r.retstart").cast("long").alias("start"))
    return ids.groupBy("id").agg(F.min(F.col("start") + F.col("i")).alias("place"))


def summaries(answers: DataFrame, body: str = "body") -> DataFrame:
    """(uid, record) of summary answers, record being a map of its plain fields."""
    a = answers.select(F.from_json(F.get_json_object(body, "$.result"), "map<string,string>").alias("r"))
    return a.select(F.explode("r").alias("uid", "text")).where("uid <> 'uids'").select("uid", F.from_json("text", "map<string,string>").alias("record"))


def series(answers: DataFrame, body: str = "body") -> DataFrame:
    """(accession, title, taxon, n_samples, pubmed_ids) of the expression series among summaries; other records are left out."""
    s = summaries(answers, body)
    at = lambda k: F.try_element_at("record", F.lit(k))
    ids = F.coalesce(F.from_json(at("pubmedids"), "array<string>"), F.array().cast("array<string>"))
    return s.where(at("accession").startswith("GSE")).select(at("accession").alias("accession"), at("title").alias("title"), at("taxon").alias("taxon"), at("n_samples").try_cast("int").alias("n_samples"), ids.alias("pubmed_ids")).distinct()


# ---------------------------------------------------------------- annotation answers


def go_annotations(answers: DataFrame, gene: str, body: str = "body") -> DataFrame:
    """(gene, term, evidence, aspect, negated) of a list of annotation objects, under `results` or plain."""
    item = "struct<goId:string,evidenceCode:string,goEvidence:string,aspect:string,goAspect:string,qualifier:string>"
    rows = F.coalesce(F.from_json(F.get_json_object(body, "$.results"), f"array<{item}>"), F.from_json(body, f"array<{item}>"))
    a = answers.select(gene, F.explode(rows).alias("x"))
    return a.select(gene, F.col("x.goId").alias("term"), F.coalesce("x.goEvidence", "x.evidenceCode").alias("evidence"), F.coalesce("x.aspect", "x.goAspect").alias("aspect"), F.coalesce(F.col("x.qualifier").rlike("(?i)\\bNOT\\b"), F.lit(False)).alias("negated"))


def flat_entries(answers: DataFrame, body: str = "body") -> DataFrame:
    """(entry, field, value) of flat files: a field's name fills the first twelve columns, its further lines leave them blank,
    and `///` ends an entry."""
    entries = answers.select(F.explode(F.split(body, "(?m)^///\\s*$")).alias("e")).where(F.trim("e") != "")
    fields = entries.select("e", F.explode(F.split(F.trim("e"), "\\n(?=\\S)")).alias("f"))
    name = F.trim(F.substring_index("f", " ", 1))
    lines = F.transform(F.split(F.regexp_replace("f", "^\\S+ *", ""), "\\n"), lambda x: F.trim(x))
    entry = F.regexp_extract("e", "(?m)^ENTRY\\s+(\\S+)", 1)
    return fields.select(entry.alias("entry"), name.alias("field"), F.explode(lines).alias("value"))


def protein_entries(answers: DataFrame, body: str = "body") -> DataFrame:
    """(accession, name, organism, length, locations) of protein entries in JSON."""
    at = lambda p: F.get_json_object(body, p)
    places = F.from_json(at("$.comments[*].subcellularLocations[*].location.value"), "array<string>")
    return answers.select(at("$.primaryAccession").alias("accession"), at("$.proteinDescription.recommendedName.fullName.value").alias("name"), at("$.organism.scientificName").alias("organism"), at("$.sequence.length").try_cast("int").alias("length"), F.coalesce(places, F.array(F.get_json_object(body, "$.comments[*].subcellularLocations[*].location.value"))).alias("locations"))


def first_hit(answers: Sequence[tuple[str, DataFrame]], key: str, usable: Column) -> DataFrame:
    """(key, source, and the answer's columns): of several sources, in their order, the first whose answer is usable; keys
    without one keep the source `none`. The answers have the same columns."""
    every = None
    for rank, (name, df) in enumerate(answers):
        one = df.withColumns({"_rank": F.lit(rank), "source": F.lit(name)})
        every = one if every is None else every.unionByName(one)
    columns = [c for c in every.columns if c not in (key, "_rank", "source")]
    best = F.min(F.when(usable, F.struct("_rank", "source", *columns))).alias("b")
    g = every.groupBy(key).agg(best)
    return g.select(key, F.coalesce("b.source", F.lit("none")).alias("source"), *(F.col(f"b.{c}").alias(c) for c in columns))
