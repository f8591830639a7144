"""Readers of landed annotation exports, and payload parsers over columns that hold JSON or flat text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.sources.files import read_tsv

FEATURES = (
    "feature_id string, type string, qualifier string, name string, gene string, alias string, parent string, secondary string, chromosome string, "
    "start long, stop long, strand string, genetic_position string, coordinate_version string, sequence_version string, description string"
)


def read_features(spark: SparkSession, path: str, aliases: bool = False) -> DataFrame:
    """Feature lines with half-open coordinates from 0, whatever the strand's order; aliases as a list if asked."""
    rows = spark.read.option("sep", "\t").option("quote", "").schema(FEATURES).csv(path).where("feature_id IS NOT NULL")
    out = rows.withColumns({"low": F.least("start", "stop") - 1, "high": F.greatest("start", "stop"), "forward": F.col("strand") == "W"})
    return out.withColumn("aliases", F.filter(F.split(F.coalesce("alias", F.lit("")), "\\|"), lambda x: x != "")) if aliases else out


def read_by_heading(spark: SparkSession, path: str, wanted: dict[str, str]) -> tuple[DataFrame, list[str]]:
    """Columns of a tab-separated export picked by heading, not by place: (rows, headings that it lacks)."""
    df = read_tsv(spark, path)
    have = {h: n for h, n in wanted.items() if h in df.columns}
    return df.select(*(F.col(f"`{h}`").alias(n) for h, n in have.items())), [h for h in wanted if h not in have]


def cofactors(c: Column) -> Column:
    """Names in a cofactor field: `COFACTOR: Name=Mg(2+); Xref=...; Name=FAD;` gives [Mg(2+), FAD]."""
    return F.regexp_extract_all(c, F.lit("Name=([^;]+);"), F.lit(1))


def locations(c: Column) -> Column:
    """Places in a location field, without notes in braces."""
    plain = F.regexp_replace(F.regexp_replace(c, "^SUBCELLULAR LOCATION:", ""), "\\{[^}]*\\}|Note=.*$", "")
    return F.filter(F.transform(F.split(plain, "[.;]"), lambda x: F.trim(x)), lambda x: x != "")


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """Gene lists of two or four columns: (id, type, position, symbols, description)."""
    cols = F.split("value", "\t")
    last = F.element_at(cols, -1)
    four = F.size(cols) == 4
    rows = spark.read.text(path).where(F.trim("value") != "")
    symbols = F.when(last.contains(";"), F.transform(F.split(F.substring_index(last, ";", 1), ","), lambda x: F.trim(x)))
    return rows.select(F.get(cols, F.lit(0)).alias("id"), F.when(four, F.get(cols, F.lit(1))).alias("type"), F.when(four, F.get(cols, F.lit(2))).alias("position"), symbols.alias("symbols"), F.trim(F.regexp_replace(last, "^[^;]*;", "")).alias("description"))


def read_links(spark: SparkSession, path: str) -> DataFrame:
    """(id, pathway) links without their prefixes."""
    cols = F.split("value", "\t")
    bare = lambda i: F.element_at(F.split(F.get(cols, F.lit(i)), ":"), -1)
    return spark.read.text(path).where(F.size(cols) == 2).select(bare(0).alias("id"), bare(1).alias("pathway"))


def read_runinfo(spark: SparkSession, path: str) -> DataFrame:
    """Run tables: one row per run, numbers as numbers, blanks as NULL; repeated headings inside the file are dropped."""
    df = spark.read.option("header", True).option("nullValue", "").csv(path).where("Run IS NOT NULL AND Run <> 'Run'")
    return df.withColumns({c: F.col(c).try_cast("long") for c in ("spots", "bases") if c in df.columns})


def fill_url(template: str, fields: dict[str, Column]) -> Column:
    """A url template `https://x/{id}` with columns in its places; a place without a column is an error."""
    import re

    names = re.findall(r"\{(\w+)\}", template)
    if missing := [n for n in names if n not in fields]:
        raise ValueError(f"no value for {', '.join(missing)}")
    out = F.lit(template)
    for n in names:
        out = F.replace(out, F.lit("{" + n + "}"), fields[n].cast("string"))
    return out
