"""Provenance walk: from an assertion over its evidence to a publication or to an analysis, its run and its dataset.

A hop that points at a row that isn't there is a break; a hop that was never recorded is a gap. Every hop is one outer
join of all pointers at once, whatever kind of row they point at, against one table of citable rows. Very many pointers
may name one row, or none: they are spread over salted keys, so that no task gets them all.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of breaks and gaps; columns of evidence that cite a row, and the kind of row.
BREAK_KINDS = ("no_evidence", "dangling_subject", "dangling_object", "evidence_cites_nothing", "dangling_citation", "span_publication_mismatch", "extraction_publication_mismatch", "no_curation_event", "curation_event_unnamed")
GAP_KINDS = ("dataset_unreachable",)
CITED = {"publication_id": "publication", "span_id": "span", "extraction_id": "extraction", "measurement_id": "measurement", "analysis_result_id": "analysis_result", "processing_run_id": "processing_run", "strain_id": "strain"}
#: Kinds of rows that a cited row can belong to, and its columns that say to which.
OWNERS = {"publication": "publication_id", "processing_run": "processing_run_id", "dataset": "dataset_id"}
#: Columns by which evidence can reach a source.
SOURCES = ("publication_id", "analysis_result_id", "processing_run_id", "extraction_id", "span_id")


#: Keys that pointers at one row are spread over, and those that point nowhere.
SALTS, NOWHERE = 64, 4096


def _spread(pointers: DataFrame, *columns: str) -> DataFrame:
    """pointers (kind, id, ...) with a `_salt` drawn from the given columns; pointers at nothing have more of them."""
    h = F.xxhash64(*columns)
    nowhere = F.col("kind").isNull() | F.col("id").isNull()
    return pointers.withColumn("_salt", F.when(nowhere, F.pmod(h, F.lit(NOWHERE))).otherwise(F.pmod(h, F.lit(SALTS))))


def _wanted(pointers: DataFrame) -> DataFrame:
    """The keys that salted pointers name: counted together in each task, so a row that very many point at costs little."""
    return pointers.where("kind IS NOT NULL AND id IS NOT NULL").select("kind", "id", "_salt").distinct()


def _resolved(pointers: DataFrame, citable: DataFrame, *spread: str) -> DataFrame:
    """pointers (kind, id, ...), spread by the given columns, with `present`: whether the row that they point at is there."""
    salted = _spread(pointers, *spread)
    there = _wanted(salted).join(citable.select("kind", "id"), ["kind", "id"]).withColumn("present", F.lit(True))
    return salted.join(there, ["kind", "id", "_salt"], "left").drop("_salt").withColumn("present", F.coalesce("present", F.lit(False)))


def walk_evidence(evidence: DataFrame, citable: DataFrame, cited: Mapping[str, str] = CITED) -> DataFrame:
    """(assertion_id, evidence_id, arms, breaks, gaps) of each row of evidence.

    evidence has evidence_id, assertion_id and the columns of `cited`, null where nothing is cited; citable is (kind, id,
    publication_id, processing_run_id, dataset_id), each (kind, id) once. A span or an extraction reaches a publication of
    its own; where the evidence names another, that is the break. An analysis result reaches a run and a dataset. breaks are
    (kind, at), at being the column or hop; arms are those that close. A row that cites nothing has that as its break.

    The rows that are cited at all follow their own pointers first, each once a salt. Evidence then meets them in a single
    join, and what its pointers found are the bits of one number.
    """
    pointer = [F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("cites"), F.lit(k).alias("kind"), F.col(c).alias("id"))) for c, k in cited.items()]
    names = F.col("publication_id").alias("named")
    first = evidence.select("assertion_id", "evidence_id", names, F.explode_outer(F.array_compact(F.array(*pointer))).alias("p")).select("assertion_id", "evidence_id", "named", "p.*")
    first = _spread(first, "assertion_id", "evidence_id")
    # what the cited rows point at themselves; a row that points nowhere stays, for its own sake
    known = _wanted(first).join(citable.select("kind", "id", *OWNERS.values()), ["kind", "id"])
    follow = {("span", "publication"), ("extraction", "publication"), ("analysis_result", "processing_run"), ("analysis_result", "dataset")}
    hops = [F.when((F.col("kind") == k) & F.col(OWNERS[to]).isNotNull(), F.struct(F.lit(to).alias("kind"), F.col(OWNERS[to]).alias("id"))) for k, to in sorted(follow)]
    own = [F.col("kind").alias("cited_kind"), F.col("id").alias("cited_id"), F.col("_salt").alias("cited_salt")]
    second = known.select(*own, F.explode_outer(F.array_compact(F.array(*hops))).alias("h")).select("cited_kind", "cited_id", "cited_salt", "h.*")
    second = _resolved(second, citable, "cited_kind", "cited_id", "cited_salt")
    found = []
    for to in OWNERS:
        there = F.col("kind") == to
        found += [F.max(F.when(there, F.col("id"))).alias(f"{to}_id"), F.coalesce(F.bool_or(there & F.col("present")), F.lit(False)).alias(f"{to}_present")]
    known = second.groupBy(F.col("cited_kind").alias("kind"), F.col("cited_id").alias("id"), F.col("cited_salt").alias("_salt")).agg(*found).withColumn("present", F.lit(True))
    first = first.join(known, ["kind", "id", "_salt"], "left")

    tests = {}  # name of a bit -> the pointers that set it
    for c in cited:
        mine = F.col("cites") == c
        tests[f"{c} cited"], tests[f"{c} present"] = mine, mine & F.col("present")
        if c in ("span_id", "extraction_id"):
            tests[f"{c} owner"], tests[f"{c} differs"] = mine & F.col("publication_present"), mine & (F.col("publication_id") != F.col("named"))
        if c == "analysis_result_id":
            tests[f"{c} run"], tests[f"{c} deposit"], tests[f"{c} dataset"] = mine & F.col("processing_run_present"), mine & F.col("dataset_id").isNotNull(), mine & F.col("dataset_present")
    if len(tests) > 63:
        raise ValueError("too many columns cite for the bits of one number")
    places = {name: 1 << i for i, name in enumerate(tests)}
    bits = sum((F.when(test, F.lit(places[name])).otherwise(F.lit(0)).cast("long") for name, test in tests.items()), F.lit(0).cast("long"))
    e = first.select("assertion_id", "evidence_id", bits.alias("bits")).groupBy("assertion_id", "evidence_id").agg(F.bit_or("bits").alias("bits"))

    def bit(name: str) -> Column:
        return F.col("bits").bitwiseAND(F.lit(places[name])) != 0 if name in places else F.lit(False)

    def has(c: str) -> Column:
        return bit(f"{c} present")

    broken = lambda test, kind, at: F.when(test, F.struct(F.lit(kind).alias("kind"), F.lit(at).alias("at")))
    breaks = [broken(bit(f"{c} cited") & ~has(c), "dangling_citation", c) for c in cited]
    closes = has("publication_id")
    for c, kind in (("extraction_id", "extraction"), ("span_id", "span")):
        there, differ = bit(f"{c} owner"), bit(f"{c} differs")
        breaks += [broken(has(c) & ~there, "dangling_citation", f"{kind} to publication"), broken(has(c) & there & differ, f"{kind}_publication_mismatch", c)]
        closes = closes | (has(c) & there & ~differ)
    result, run = has("analysis_result_id"), has("processing_run_id")
    breaks.append(broken(result & ~bit("analysis_result_id run"), "dangling_citation", "analysis_result to processing_run"))
    deposit = result & bit("analysis_result_id deposit")
    breaks.append(broken(deposit & ~bit("analysis_result_id dataset"), "dangling_citation", "analysis_result to dataset"))
    analysed = (result & bit("analysis_result_id run")) | (~result & run)
    gaps = F.array_compact(F.array(F.when((result | run) & ~deposit, F.lit("dataset_unreachable"))))
    arms = F.array_compact(F.array(F.when(closes, F.lit("literature")), F.when(analysed, F.lit("analysis"))))
    e = e.select("assertion_id", "evidence_id", arms.alias("arms"), F.array_compact(F.array(*breaks)).alias("breaks"), gaps.alias("gaps"), (~reduce(or_, (bit(f"{c} cited") for c in SOURCES))).alias("sourceless"))
    nothing = (F.size("arms") == 0) & (F.col("sourceless") | (F.size("breaks") == 0))
    none = F.array(F.struct(F.lit("evidence_cites_nothing").alias("kind"), F.lit("evidence").alias("at")))
    return e.withColumn("breaks", F.when(nothing, F.concat("breaks", none)).otherwise(F.col("breaks"))).drop("sourceless")


def walk_assertions(assertions: DataFrame, evidence: DataFrame, citable: DataFrame, curation: DataFrame, subject_kinds: Mapping[str, str], object_kinds: Mapping[str, str]) -> DataFrame:
    """(assertion_id, n_evidence, complete, gaps, and a count for each of BREAK_KINDS) of every active assertion.

    assertions are (assertion_id, status, subject_type, subject_id, object_type, object_id), evidence as for walk_evidence
    with a status, curation (target_id, curator). A subject or object whose type names no kind, or that isn't there,
    dangles; a literal object doesn't. Only active evidence counts. Breaks are counted in each task before they are
    shuffled, so an assertion with very many rows of evidence is no one task's.
    """
    live = assertions.where("status = 'active'")
    ends = []
    for end, kinds in (("subject", subject_kinds), ("object", object_kinds)):
        kind = F.element_at(F.create_map(*(F.lit(x) for pair in kinds.items() for x in pair)), F.col(f"{end}_type"))
        ends.append(F.struct(F.lit(end).alias("end"), kind.alias("kind"), F.col(f"{end}_id").alias("id"), F.coalesce(F.col(f"{end}_type") == "literal", F.lit(False)).alias("free")))
    pointers = live.select("assertion_id", F.inline(F.array(*ends)))
    dangling = _resolved(pointers, citable, "assertion_id").where("NOT present AND NOT (free AND end = 'object')").groupBy("assertion_id").agg(*(F.max((F.col("end") == e).cast("long")).alias(f"dangling_{e}") for e in ("subject", "object")))
    walked = walk_evidence(evidence.where("status = 'active'"), citable)
    inner = [k for k in BREAK_KINDS if "cit" in k or "mismatch" in k]
    count = lambda k: F.sum(F.size(F.filter("breaks", lambda b: b["kind"] == k))).alias(k)
    sums = walked.groupBy("assertion_id").agg(F.count("*").alias("n_evidence"), F.sum(F.size("gaps")).alias("gaps"), *map(count, inner))
    events = curation.groupBy(F.col("target_id").alias("assertion_id")).agg(F.count("*").alias("events"), F.count_if(F.trim(F.coalesce("curator", F.lit(""))) != "").alias("curators"))
    a = live.select("assertion_id").join(dangling, "assertion_id", "left").join(sums, "assertion_id", "left").join(events, "assertion_id", "left").na.fill(0)
    a = a.withColumns({"no_evidence": (F.col("n_evidence") == 0).cast("long"), "no_curation_event": (F.col("events") == 0).cast("long"), "curation_event_unnamed": ((F.col("events") > 0) & (F.col("curators") == 0)).cast("long")})
    broken = sum((F.col(k) for k in BREAK_KINDS), F.lit(0))
    return a.select("assertion_id", "n_evidence", (broken == 0).alias("complete"), "gaps", *BREAK_KINDS)
