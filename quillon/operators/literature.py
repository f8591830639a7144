"""Literature rules: triage, rescreening of full texts, admission, quotes, and matching of files that were fetched by hand."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import sections as S
from quillon.functions import text as X


def triage(default: Column, excluded: Column, admitted: Column, has_full_text: Column) -> Column:
    """State of a paper under its family's rule. An including family takes what isn't excluded; an excluding one what is
    admitted, and without a full text to admit by, the paper waits for one."""
    including = F.when(excluded, "excluded").otherwise("included")
    excluding = F.when(admitted, "included").when(has_full_text, "excluded").otherwise("needs_full_text")
    return F.when(default == "include", including).when(default == "exclude", excluding)


def rescreen(docs: DataFrame, text: str, pattern: str, genotype: str, least: int) -> DataFrame:
    """docs with mentions, in_body and best: how often a pattern is named, whether a genotype stands outside the head, and the
    section with most mentions, the first of equals. Kept are papers with at least `least` mentions and a genotype in the body.

    The head is the front matter and abstract; a text without sections has no head.
    """
    d = docs.withColumn("_s", S.split_sections(F.col(text)))
    part = lambda s: F.substr(F.col(text), s["start"] + 1, s["end"] - s["start"])
    count = lambda c, p: F.size(F.regexp_extract_all(c, F.lit(f"(?i){p}"), F.lit(0)))
    by = F.transform("_s", lambda s: F.struct(count(part(s), pattern).alias("n"), (-s["start"]).alias("place"), s["name"].alias("name"), s["name"].isin("front_matter", "abstract").alias("head"), (count(part(s), genotype) > 0).alias("has")))
    d = d.withColumn("_by", by)
    out = d.withColumns({"mentions": count(F.col(text), pattern), "in_body": F.exists("_by", lambda x: x["has"] & ~x["head"]), "best": F.array_max("_by")["name"]})
    return out.where((F.col("mentions") >= least) & F.col("in_body")).drop("_s", "_by")


def admission_problems(counts: Mapping[str, Column], caps: Mapping[str, int]) -> Column:
    """Names of the budgets that an admission breaks; what one leaves unspent is nobody else's."""
    return F.array_compact(F.array(*(F.when(c > caps[k], F.lit(k)) for k, c in counts.items())))


def verify_quotes(records: DataFrame, texts: DataFrame, key: str, text: str, start: str, quote: str) -> DataFrame:
    """records with verdict and nearest: whether each quote stands where it is said to in its paper's text, and the place
    nearest to the claim where it does stand."""
    j = records.join(texts.select(key, text), key, "left")
    places = X.find_all(F.col(text), F.col(quote))
    near = F.array_min(F.transform(places, lambda p: F.struct(F.abs(p - F.col(start)).alias("d"), p.alias("p"))))["p"]
    return j.withColumns({"verdict": X.span_verdict(F.col(text), F.col(start), F.col(quote)), "nearest": near}).drop(text)


def match_files(files: DataFrame, papers: DataFrame, identifiers: Sequence[str], least: float = 0.6) -> DataFrame:
    """(file, paper, verdict) of files (file, one column per identifier, opening) against papers (paper, the same
    identifiers, title).

    The first identifier that names exactly one paper decides; the title must then not speak against it: below `least` of
    its distinctive words in the file's opening text is title_mismatch, an overlap that can't be worked out passes.
    No identifier is unmatched, several papers are ambiguous.
    """
    named = lambda df, who: df.select(who, F.explode(F.array(*(F.struct(F.lit(i).alias("rank"), F.lower(c).alias("key")) for i, c in enumerate(identifiers)))).alias("k")).select(who, "k.*").where("key IS NOT NULL")
    owners = named(papers, "paper").groupBy("rank", "key").agg(F.min("paper").alias("paper"), (F.min("paper") == F.max("paper")).alias("one"))
    found = named(files, "file").join(owners, ["rank", "key"]).groupBy("file").agg(F.min(F.when(F.col("one"), F.struct("rank", "paper")))["paper"].alias("paper"), F.count("*").alias("hits"))
    j = files.select("file", "opening").join(found, "file", "left").join(papers.select("paper", "title"), "paper", "left")
    overlap = X.title_overlap(F.col("title"), F.col("opening"))
    verdict = F.when(F.col("hits").isNull(), "unmatched").when(F.col("paper").isNull(), "ambiguous").when(F.coalesce(overlap < least, F.lit(False)), "title_mismatch").otherwise("stored")
    return j.select("file", "paper", verdict.alias("verdict"))
