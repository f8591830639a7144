"""Readers of landed files. All go through Spark's readers, so any file system that Spark reaches will do."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GFF3 = "seqid string, source string, type string, start long, end long, score string, strand string, phase string, attributes string"
GAF = (
    "db string, object_id string, symbol string, qualifier string, term_id string, reference string, evidence_code string, with_from string, aspect string, "
    "name string, synonym string, object_type string, taxon string, date string, assigned_by string, extension string, product_form string"
)


def read_tsv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Tab-separated text with a heading; lines that begin with # are comments, blanks are NULL and never 0."""
    reader = spark.read.option("comment", "#").option("sep", "\t").option("header", True).option("nullValue", "").option("quote", "")
    return (reader.schema(schema) if schema else reader).csv(path)


def read_matrix(spark: SparkSession, path: str, samples: Sequence[str] | None = None) -> DataFrame:
    """(gene, sample, value) of a gene x sample text matrix, gzip or not; only the wanted samples' columns are read."""
    wide = spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(path)
    names = [c for c in wide.columns[1:] if samples is None or c in samples]
    gene = wide.columns[0]
    typed = wide.select(F.col(f"`{gene}`").alias("gene"), *(F.col(f"`{c}`").try_cast("double").alias(c) for c in names))
    return typed.unpivot(["gene"], names, "sample", "value")


def matrix_samples(spark: SparkSession, path: str) -> list[str]:
    """Samples that a matrix holds, from its heading alone."""
    return spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(path).columns[1:]


def read_gff3(spark: SparkSession, path: str) -> DataFrame:
    """Features with half-open starts from 0, attributes as a map of lists, and the owner: the parent, or the id itself."""
    rows = spark.read.option("sep", "\t").option("comment", "#").option("quote", "").schema(GFF3).csv(path)
    out = rows.withColumn("attributes", gff_attributes(F.col("attributes")))
    first = lambda k: F.get(F.try_element_at("attributes", F.lit(k)), F.lit(0))
    return out.withColumns({"start": F.col("start") - 1, "id": first("ID"), "owner": F.coalesce(first("Parent"), first("ID"))})


def unescaped(c: Column) -> Column:
    """Text with its %XX escapes read as UTF-8; a plus sign is a plus sign."""
    return F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def gff_attributes(c: Column) -> Column:
    """Attributes of a line as a map of lists. Lists are split before they are unescaped, so an escaped comma stays in its
    value; a tag that stands twice has both lists' values. An entry without `=` is left out."""
    entries = F.filter(F.transform(F.split(c, ";"), lambda x: F.trim(x)), lambda x: x.contains("="))
    pairs = F.transform(entries, lambda x: F.struct(unescaped(F.trim(F.substring_index(x, "=", 1))).alias("k"), F.transform(F.split(F.regexp_replace(x, "^[^=]*=", ""), ","), unescaped).alias("v")))
    tags = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    values = F.transform(tags, lambda k: F.flatten(F.transform(F.filter(pairs, lambda p: p["k"] == k), lambda p: p["v"])))
    return F.map_from_arrays(tags, values)


def gene_records(features: DataFrame) -> DataFrame:
    """One row per owner: its span and how many features it owns, of each type."""
    g = features.where("owner IS NOT NULL").groupBy("seqid", "owner")
    return g.agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("features"), F.array_sort(F.collect_set("type")).alias("types"))


def read_gaf(spark: SparkSession, path: str) -> DataFrame:
    """Gene annotation lines; `negated` marks NOT qualifiers, which state an absence."""
    rows = spark.read.option("sep", "\t").option("comment", "!").option("quote", "").schema(GAF).csv(path)
    return rows.withColumn("negated", F.array_contains(F.split(F.coalesce("qualifier", F.lit("")), "\\|"), "NOT"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, description, sequence) of each record; gzip by suffix."""
    rows = spark.read.option("lineSep", "\n>").text(path).withColumn("value", F.regexp_replace("value", "^>", "")).where(F.trim("value") != "")
    head = F.substring_index("value", "\n", 1)
    body = F.expr("substring(value, length(substring_index(value, '\\n', 1)) + 2)")
    return rows.select(F.substring_index(head, " ", 1).alias("name"), F.trim(F.regexp_replace(head, "^\\S+", "")).alias("description"), F.upper(F.regexp_replace(body, "\\s", "")).alias("sequence"))


def _features(text: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """Feature key, location and qualifiers of a GenBank flat file's feature table."""
    inside, key, place, notes = False, None, "", []

    def done():
        joined, found = " ".join(notes), {}
        for part in joined.split(" /"):
            name, _, value = part.strip().lstrip("/").partition("=")
            if name:
                found[name] = value.strip().strip('"')
        return key, place, found

    for line in text.splitlines():
        if line.startswith("FEATURES"):
            inside = True
        elif inside and line[:1] not in (" ", ""):
            break
        elif inside and line[5:6].strip():
            if key:
                yield done()
            key, place, notes = line[5:21].strip(), line[21:].strip(), []
        elif inside and key:
            piece = line[21:].strip()
            if not piece.startswith("/") and not notes:
                place += piece
            else:
                notes.append(piece)
    if key:
        yield done()


def read_genbank(spark: SparkSession, path: str) -> DataFrame:
    """(path, key, location, start, end, strand, qualifiers) of every feature. A file is one row to Spark; the feature
    table's line grammar is read in Python."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, *f) for p, v in zip(pdf["path"], pdf["value"]) for f in _features(v)]
            yield pd.DataFrame(rows, columns=["path", "key", "location", "qualifiers"])

    out = files.mapInPandas(run, "path string, key string, location string, qualifiers map<string,string>")
    return out.select("path", "key", "location", location(F.col("location")).alias("l"), "qualifiers").select("path", "key", "location", "l.*", "qualifiers")


def location(c: Column) -> Column:
    """(start, end, strand, segments) of an INSDC location: `join`, `order` and `complement`, open ends and remote entries.

    segments are (entry, start, end, open_start, open_end) in written order, half-open from 0; start and end span those of
    the entry itself. strand is -1 under a complement.
    """
    parts = F.regexp_extract_all(c, F.lit("(?:[A-Za-z_][\\w.]*:)?<?\\d+(?:\\.\\.>?\\d+)?"), F.lit(0))

    def segment(x: Column) -> Column:
        entry = F.nullif(F.regexp_extract(x, "^([A-Za-z_][\\w.]*):", 1), F.lit(""))
        low = F.regexp_extract(x, "(?:^|:)<?(\\d+)", 1).cast("long")
        high = F.nullif(F.regexp_extract(x, "\\.\\.>?(\\d+)", 1), F.lit("")).cast("long")
        return F.struct(entry.alias("entry"), (low - 1).alias("start"), F.coalesce(high, low).alias("end"), x.contains("<").alias("open_start"), x.contains(">").alias("open_end"))

    segments = F.transform(parts, segment)
    own = F.filter(segments, lambda s: s["entry"].isNull())
    strand = F.when(c.contains("complement("), -1).otherwise(1)
    return F.struct(F.array_min(F.transform(own, lambda s: s["start"])).alias("start"), F.array_max(F.transform(own, lambda s: s["end"])).alias("end"), strand.alias("strand"), segments.alias("segments"))


def assemble_quantities(quants: DataFrame, transcripts: DataFrame) -> DataFrame:
    """(gene, sample, count, tpm) from transcript rows (sample, transcript, count, tpm) and (transcript, gene); genes of
    the map that a sample lacks are explicit zeros."""
    sums = quants.join(transcripts, "transcript").groupBy("gene", "sample").agg(F.sum("count").alias("count"), F.sum("tpm").alias("tpm"))
    frame = transcripts.select("gene").distinct().crossJoin(F.broadcast(quants.select("sample").distinct()))
    return frame.join(sums, ["gene", "sample"], "left").na.fill(0.0, ["count", "tpm"])


def running_phase(segments: DataFrame, model: str) -> DataFrame:
    """segments (start, end, phase, strand) with the phase that each should have: (3 - bases % 3) % 3 for the bases before it in
    coding order, less the first segment's own phase; the first segment's stays."""
    by = Window.partitionBy(model).orderBy("_place")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    sign = F.when(F.col("strand") < 0, -1).otherwise(1) if "strand" in segments.columns else F.lit(1)
    s = segments.withColumn("_place", F.col("start") * sign)
    bases = F.sum(F.col("end") - F.col("start")).over(before) - F.first("phase").over(by)
    expected = F.when(bases.isNull(), F.col("phase")).otherwise(F.pmod(-bases, F.lit(3))).cast("int")
    return s.withColumn("expected_phase", expected).drop("_place")
