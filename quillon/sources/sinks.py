"""Writers: zone-partitioned releases with a manifest, results with provenance, worklists."""

from __future__ import annotations

import html
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_release(df: DataFrame, path: str, keys: Sequence[str], zone: str = "zone") -> DataFrame:
    """JSON lines by zone in key order, each with its absent columns named; returns the manifest (zone, rows, digest).

    The digest adds up row hashes, so it doesn't depend on order or on files.
    """
    absent = F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in df.columns if c not in keys)))
    rows = df.withColumn("_absence", absent)
    rows.repartitionByRange(zone, *keys).sortWithinPartitions(zone, *keys).write.mode("overwrite").partitionBy(zone).json(path)
    h = F.conv(F.substring(F.sha2(F.to_json(F.struct(*df.columns)), 256), 1, 12), 16, 10).cast("decimal(38,0)")
    return df.groupBy(zone).agg(F.count("*").alias("rows"), F.hex(F.pmod(F.sum(h), F.lit(2**60)).cast("long")).alias("digest"))


def write_result(df: DataFrame, path: str, parameters: dict[str, object]) -> DataFrame:
    """Gzipped tab-separated payload; returns its provenance row (path, parameters_hash, columns)."""
    df.write.mode("overwrite").option("sep", "\t").option("header", True).option("compression", "gzip").csv(path)
    text = ";".join(f"{k}={parameters[k]}" for k in sorted(parameters))
    return df.sparkSession.createDataFrame([(path, text, ",".join(df.columns))], "path string, parameters string, columns string").withColumn("parameters_hash", F.sha2("parameters", 256))


def write_worklist(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """Tab-separated files in priority order: the files' names follow the order, so that read one after the other they are
    the list. A short list is one file."""
    df.orderBy(*order).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


# ---------------------------------------------------------------- descriptors and documents


def crate(files: DataFrame, name: str, released: str, licence: str) -> str:
    """JSON-LD descriptor of a release's files (path, rows, digest, description): one entity for each, below the root.

    A release has as many files as it has tables, so the descriptor is made on the driver.
    """
    rows = files.select("path", "rows", "digest", "description").orderBy("path").collect()
    root = {"@id": "./", "@type": "Dataset", "name": name, "datePublished": released, "license": {"@id": licence}, "hasPart": [{"@id": r["path"]} for r in rows]}
    about = {"@id": "ro-crate-metadata.json", "@type": "CreativeWork", "conformsTo": {"@id": "https://w3id.org/ro/crate/1.1"}, "about": {"@id": "./"}}
    parts = [{"@id": r["path"], "@type": "File", "description": r["description"], "identifier": r["digest"], "size": r["rows"], "encodingFormat": "application/json"} for r in rows]
    return json.dumps({"@context": "https://w3id.org/ro/crate/1.1/context", "@graph": [about, root, *parts]}, ensure_ascii=False, indent=1)


def review_page(rows: DataFrame, title: str, most: int = 500) -> str:
    """An HTML page with a table and its rows embedded as JSON; it says how many rows it leaves out. All text is escaped."""
    shown = rows.limit(most + 1).toPandas()
    more = len(shown) > most
    records = json.loads(shown.head(most).to_json(orient="records", date_format="iso"))
    cell = lambda x: "" if x is None else html.escape(str(x))
    head = "".join(f"<th>{html.escape(c)}</th>" for c in rows.columns)
    body = "".join("<tr>" + "".join(f"<td>{cell(r[c])}</td>" for c in rows.columns) + "</tr>" for r in records)
    data = json.dumps(records).replace("<", "\\u003c")
    note = f"<p>The first {most} rows; there are more.</p>" if more else ""
    return f'<!doctype html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>{note}<table><tr>{head}</tr>{body}</table><script type="application/json" id="rows">{data}</script></body></html>'


def proposals(rows: DataFrame, header: dict[str, object]) -> str:
    """A YAML document of proposals for a curator: a header, then each row with its columns in order."""
    import yaml

    records = [r.asDict(recursive=True) for r in rows.collect()]  # what a curator reads
    return yaml.safe_dump({**header, "proposals": records}, sort_keys=False, allow_unicode=True)
