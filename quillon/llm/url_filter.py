"""URL filter by a tree of path templates (operator 1).

Every host has a tree of its paths, as deep as they are. Level by level, a segment with too few urls to judge is
variable and becomes the wildcard; a segment whose labelled share of blocked urls doesn't differ from its siblings'
(two-proportion test) is merged into the wildcard as well. The segments that do differ are compared among each other:
those in one band of the blocked share that the same test doesn't tell apart are merged into one branch. Paths that end
up with the same template share their labels; a template is rejected if its share of blocked urls, smoothed towards its
host's and that towards all hosts', is high enough. A segment with enough urls but no label is like none that has, and
keeps its name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm import shared

#: A segment stays by name from so many urls on, whatever its share of its siblings' urls, unless fewer than this many
#: standard errors lie between its blocked share and its siblings'.
SUPPORT, ERRORS = 5, 1.96
#: Bands of the blocked share, of equal width on the scale 2 asin(sqrt(share)), on which its spread is even.
BANDS = 6
#: A template is rejected from this smoothed share and so many labelled urls on; labels that smoothing is worth.
PURITY, LABELS, PRIOR = 0.5, 3, 4.0
#: Stands for a variable segment, and with a band's number for merged branches; no path has it.
WILD = "?"

Rule = tuple[str, str, str]
#: (verdict, host, path prefix)
RULES: list[Rule] = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a url; both empty without `://` or for null."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits, as (rule, verdict); null where none does. Rules are a short list."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):  # the longest is asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def _alike(lab: str, blk: str, all_lab: str, all_blk: str) -> Column:
    """Whether a segment's blocked share doesn't differ from the others' of a group: the two-proportion test; false where
    either has no labels."""
    lab, blk, all_lab, all_blk = F.col(lab), F.col(blk), F.col(all_lab), F.col(all_blk)
    rest = F.when(all_lab > lab, all_lab - lab)
    own = F.when(lab > 0, lab)
    pooled = all_blk / F.when(all_lab > 0, all_lab)
    apart = F.abs(blk / own - (all_blk - blk) / rest)
    return F.coalesce(apart <= ERRORS * F.sqrt(pooled * (1 - pooled) * (1.0 / own + 1.0 / rest)) + 1e-12, F.lit(False))


def band(lab: Column, blk: Column) -> Column:
    """Band of a blocked share."""
    return F.least(F.lit(BANDS - 1), F.floor(F.asin(F.sqrt(blk / lab)) * (2 * BANDS / 3.141592653589793) + 1e-9)).cast("int")


def _sums(own: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    """Sums of the segments' urls and labels by keys, and how many segments there are; summed before the shuffle."""
    return own.groupBy(*keys).agg(F.sum("lab").alias(f"{prefix}_lab"), F.sum("blk").alias(f"{prefix}_blk"), F.count("*").alias(f"{prefix}_kids"))


def merged(own: DataFrame) -> DataFrame:
    """(prefix, seg, next, paths): the template that each segment leads to, from (prefix, seg, n, lab, blk, paths)."""
    every = shared.joined(own, _sums(own, ["prefix"], "all").withColumn("weight", F.col("all_kids")), ["prefix"], "weight")
    same = (F.col("all_kids") > 1) & _alike("lab", "blk", "all_lab", "all_blk")
    wild = (F.col("n") < SUPPORT) | same
    every = shared.table(every.withColumn("wild", wild).withColumn("band", F.when(~wild & (F.col("lab") > 0), band(F.col("lab"), F.col("blk")))))
    banded = every.where("band is not null")
    groups = _sums(banded, ["prefix", "band"], "band").withColumn("weight", F.col("band_kids"))
    banded = shared.joined(banded, groups, ["prefix", "band"], "weight")
    with_others = (F.col("band_kids") > 1) & _alike("lab", "blk", "band_lab", "band_blk")
    banded = banded.select("prefix", "seg", "paths", F.when(with_others, F.concat(F.lit(WILD), F.col("band"))).otherwise(F.col("seg")).alias("as"))
    others = every.where("band is null").select("prefix", "seg", "paths", F.when(F.col("wild"), F.lit(WILD)).otherwise(F.col("seg")).alias("as"))
    return banded.union(others).select("prefix", "seg", F.concat("prefix", F.lit("/"), "as").alias("next"), "paths")


def grow(urls: DataFrame) -> DataFrame:
    """(host, path, template, share, rejected, urls) of distinct (host, path, n, lab, blk).

    The tree grows until no path has a further segment. Each level reads only the paths that reach it and writes them
    with their prefix and the rest of their segments; a path is done when its rest is empty.
    """
    spark, base = urls.sparkSession, shared.folder(urls.sparkSession)
    rows = urls.withColumn("rest", F.filter(F.split("path", "/"), lambda x: x != "")).withColumn("prefix", F.col("host"))
    levels: list[str] = []
    while True:
        levels.append(f"{base}/level-{len(levels)}")
        rows.write.parquet(levels[-1])
        deeper = spark.read.schema(rows.schema).parquet(levels[-1]).where(F.size("rest") > 0)
        if deeper.isEmpty():
            break
        deeper = deeper.withColumn("seg", F.get("rest", F.lit(0)))
        own = deeper.groupBy("prefix", "seg").agg(F.sum("n").alias("n"), F.sum("lab").alias("lab"), F.sum("blk").alias("blk"), F.count("*").alias("paths"))
        names = shared.table(merged(shared.table(own)))
        rows = shared.joined(deeper, names, ["prefix", "seg"], "paths").withColumns({"prefix": F.col("next"), "rest": F.slice("rest", 2, F.size("rest"))}).select(rows.columns)
    done = spark.read.schema(rows.schema).parquet(*levels).where(F.size("rest") == 0).withColumn("template", F.col("prefix"))
    total = urls.agg(F.coalesce(F.sum("lab"), F.lit(0)).alias("lab"), F.coalesce(F.sum("blk"), F.lit(0)).alias("blk")).first()
    top = (total["blk"] + 1) / (total["lab"] + 2)
    kinds = shared.table(done.groupBy("host", "template").agg(F.sum("lab").alias("tl"), F.sum("blk").alias("tb"), F.count("*").alias("paths")))
    hosts = kinds.groupBy("host").agg(((F.sum("tb") + PRIOR * top) / (F.sum("tl") + PRIOR)).alias("base"), F.count("*").alias("weight"))
    kinds = shared.joined(kinds, hosts, ["host"], "weight").withColumn("share", (F.col("tb") + PRIOR * F.col("base")) / (F.col("tl") + PRIOR))
    kinds = shared.table(kinds.select("template", "share", ((F.col("share") >= PURITY) & (F.col("tl") >= LABELS)).alias("rejected"), "paths"))
    return shared.table(shared.joined(done.select("host", "path", "template", F.col("n").alias("urls")), kinds, ["template"], "paths"))


def judge(pages: DataFrame, rules: list[Rule] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, template, share) of every url (operator 1).

    The longest rule that fits decides; else `block` for urls of rejected templates and `allow` for the rest, also for
    empty hosts. Urls under a rule are the labelled ones. A template begins with its host. Null urls have an empty
    host and path. Rows, also repeated ones, stay, and each counts as a url; null ids stay; other columns are not
    read; an empty table gives no rows; a path of any length is read to its end. All counts are summed before they are
    shuffled and joined back with the largest groups broadcast, so no host, branch or url fills one task.
    """
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "given": verdict})
    urls = rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.count("given").alias("lab"), F.count_if(F.col("given") == "block").alias("blk"))
    out = shared.joined(rows, grow(shared.table(urls)), ["host", "path"], "urls")
    verdict = F.coalesce("given", F.when(F.col("rejected"), "block").otherwise("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "template", "share")


#: The whole tree and its decisions once more, in DuckDB's own words.
ORACLE = """
WITH RECURSIVE r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM r),
rules AS (SELECT * FROM (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) v(kind, rh, rp)),
g AS (SELECT h.*, (SELECT arg_max(struct_pack(kind := kind, rule := rh || rp), length(rh || rp)) FROM rules
  WHERE (h.host = rh OR ends_with(h.host, '.' || rh)) AND starts_with(h.path, rp)) AS m FROM h),
u AS (SELECT host, path, count(*) AS n, count(m) AS lab, count(*) FILTER (m.kind = 'block') AS blk FROM g GROUP BY host, path),
w AS (SELECT host, path, n, lab, blk, list_filter(string_split(path, '/'), lambda x: x <> '') AS rest, host AS prefix FROM u
  UNION ALL
  SELECT host, path, n, lab, blk, rest[2:] AS rest,
    prefix || '/' || CASE WHEN wild THEN '?' WHEN band IS NOT NULL AND bk > 1 AND bl > sl
      AND abs(sb / sl - (bb - sb) / (bl - sl)) <= 1.96 * sqrt(bb / bl * (1 - bb / bl) * (1 / sl + 1 / (bl - sl))) + 1e-12 THEN '?' || band ELSE seg END AS prefix
  FROM (SELECT *, sum(lab) OVER q AS bl, sum(blk) OVER q AS bb, count(DISTINCT seg) OVER q AS bk
    FROM (SELECT *, CASE WHEN NOT wild AND sl > 0 THEN least(5, floor(asin(sqrt(sb / sl)) * 12 / pi() + 1e-9))::INT END AS band
      FROM (SELECT *, sn < 5 OR coalesce(ak > 1 AND sl > 0 AND al > sl
          AND abs(sb / sl - (ab - sb) / (al - sl)) <= 1.96 * sqrt(ab / al * (1 - ab / al) * (1 / sl + 1 / (al - sl))) + 1e-12, false) AS wild
        FROM (SELECT *, rest[1] AS seg, sum(n) OVER s AS sn, (sum(lab) OVER s)::DOUBLE AS sl, (sum(blk) OVER s)::DOUBLE AS sb,
            (sum(lab) OVER p)::DOUBLE AS al, (sum(blk) OVER p)::DOUBLE AS ab, count(DISTINCT rest[1]) OVER p AS ak
          FROM w WHERE len(rest) > 0 WINDOW s AS (PARTITION BY prefix, rest[1]), p AS (PARTITION BY prefix)) x1) x2) x3
    WINDOW q AS (PARTITION BY prefix, band)) x4),
l AS (SELECT host, path, n, lab, blk, prefix FROM w WHERE len(rest) = 0),
b AS (SELECT host, (sum(blk) + 4 * (SELECT (sum(blk) + 1) / (sum(lab) + 2)::DOUBLE FROM u)) / (sum(lab) + 4) AS base FROM l GROUP BY host),
t AS (SELECT l.prefix, sum(lab) AS tl, (sum(blk) + 4 * any_value(base)) / (sum(lab) + 4) AS share FROM l JOIN b ON l.host = b.host GROUP BY l.prefix)
SELECT g.page_id, g.host, g.path, g.m.rule AS rule, coalesce(g.m.kind, CASE WHEN t.share >= 0.5 AND t.tl >= 3 THEN 'block' ELSE 'allow' END) AS verdict,
  l.prefix AS template, t.share::DOUBLE AS share
FROM g JOIN l ON g.host = l.host AND g.path = l.path JOIN t ON t.prefix = l.prefix
"""
