"""A versioned store of Parquet tables: declared schemas, migrations with backups, fixtures, YAML documents, paths."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Mapping, Sequence
from pathlib import PurePosixPath, PureWindowsPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions import payload

Schemas = Mapping[str, str]
_scratch: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A folder for derived tables below spark.checkpoint.dir, the same for the same name; a local session without that
    setting gets a temporary folder, a cluster an error."""
    base = spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _scratch.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="quillon-store-"))
    return f"{base.rstrip('/')}/{name}-{hashlib.sha256(name.encode()).hexdigest()[:8]}"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in whatever file system it names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _rename(spark: SparkSession, old: str, new: str) -> None:
    p, q = (spark._jvm.org.apache.hadoop.fs.Path(x) for x in (old, new))
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).rename(p, q):
        raise OSError(f"{old} could not be renamed to {new}")


def create_schema(spark: SparkSession, path: str, schemas: Schemas, version: int) -> None:
    """Empty tables of the declared schemas, and the store's version; refuses a store that is there already."""
    if exists(spark, f"{path}/_version"):
        raise ValueError(f"{path} holds a store of version {schema_version(spark, path)}")
    for name, ddl in schemas.items():
        spark.createDataFrame([], ddl).write.parquet(f"{path}/{name}")
    _stamp(spark, path, version)


def _stamp(spark: SparkSession, path: str, version: int) -> None:
    spark.createDataFrame([(version,)], "version int").coalesce(1).write.mode("overwrite").json(f"{path}/_version")


def schema_version(spark: SparkSession, path: str) -> int | None:
    """Version of a store; None where there is none."""
    return spark.read.schema("version int").json(f"{path}/_version").first()["version"] if exists(spark, f"{path}/_version") else None


def open_store(spark: SparkSession, path: str, schemas: Schemas, version: int) -> dict[str, DataFrame]:
    """The store's tables by name, under their declared schemas; another version is an error, never migrated here."""
    found = schema_version(spark, path)
    if found != version:
        raise ValueError(f"{path} is of version {found}, this code of version {version}")
    return {name: spark.read.schema(ddl).parquet(f"{path}/{name}") for name, ddl in schemas.items()}


Migration = tuple[int, str, Callable[[DataFrame], DataFrame]]


def pending(at: int, steps: Sequence[Migration], to: int) -> list[Migration]:
    """Steps (version that they make, table, rewrite) from one version to another, in order; a gap is an error."""
    todo = sorted((s for s in steps if at < s[0] <= to), key=lambda s: s[0])
    if sorted({s[0] for s in todo}) != list(range(at + 1, to + 1)):
        raise ValueError(f"no chain of migrations from {at} to {to}")
    return todo


def migrate(spark: SparkSession, path: str, steps: Sequence[Migration], to: int) -> list[int]:
    """Bring a store to a version: each step rewrites a table, whose old files stay as a backup; returns versions made."""
    at = schema_version(spark, path)
    if at is None:
        raise ValueError(f"{path} holds no store")
    made: list[int] = []
    for version, table, rewrite in pending(at, steps, to):
        rewrite(spark.read.parquet(f"{path}/{table}")).write.mode("overwrite").parquet(f"{path}/_new/{table}")
        _rename(spark, f"{path}/{table}", f"{path}/_backup-{table}-{version - 1}")
        _rename(spark, f"{path}/_new/{table}", f"{path}/{table}")
        _stamp(spark, path, version)
        made.append(version)
    return made


# ---------------------------------------------------------------- documents and fixtures


def read_yaml(spark: SparkSession, path: str, schema: str, key: str | None = None, check: dict | None = None) -> DataFrame:
    """Rows of a YAML document: a list, or the list below a key. check is a JSON schema for each row; what breaks it is
    an error that names the row. Vocabularies are short, so they are read on the driver."""
    import yaml

    documents = [yaml.safe_load(r["value"]) for r in spark.read.text(path, wholetext=True).collect()]  # a few short files
    rows: list[dict] = []
    for document in documents:
        part = document[key] if key else document
        if not isinstance(part, list):
            raise ValueError(f"{path}: {key or 'the document'} is no list")
        rows += part
    if check:
        payload.supported(check)
        if broken := [f"row {i}: {e}" for i, r in enumerate(rows) for e in payload.check(r, check)]:
            raise ValueError(f"{path}: {'; '.join(broken)}")
    fields = T.StructType.fromDDL(schema)
    return spark.createDataFrame([tuple(r.get(f.name) for f in fields) for r in rows], fields)


def load_fixture(spark: SparkSession, folder: str, schemas: Schemas, order: Iterable[str]) -> dict[str, DataFrame]:
    """Tables from one YAML list each, `folder/<table>.yaml`, in the order of their foreign keys. A missing file is an
    empty table and a missing field NULL; a column that the schema lacks is an error."""
    import yaml

    out = {}
    for name in order:
        fields, path = T.StructType.fromDDL(schemas[name]), f"{folder}/{name}.yaml"
        rows = yaml.safe_load(spark.read.text(path, wholetext=True).first()["value"]) or [] if exists(spark, path) else []
        if unknown := sorted({c for r in rows for c in r} - set(fields.names)):
            raise ValueError(f"{name}: the schema has no column {', '.join(unknown)}")
        out[name] = spark.createDataFrame([tuple(r.get(c) for c in fields.names) for r in rows], fields)
    return out


# ---------------------------------------------------------------- paths


def portable_path(value: str, relative_to: str | None = None) -> str:
    """A path with forward slashes, relative to a folder where it lies below it."""
    parts = PureWindowsPath(value).parts if "\\" in value else PurePosixPath(value).parts
    path = PurePosixPath(*(p.replace("\\", "/") for p in parts))
    if relative_to:
        base = PurePosixPath(relative_to.replace("\\", "/"))
        if path.is_relative_to(base):
            path = path.relative_to(base)
    return str(path)


def resolve_stored_path(value: str, data_dir: str, present: Callable[[str], bool] = os.path.exists) -> str:
    """Where a stored path is now: as it is, or its longest tail that is there below the data folder; of whatever system
    it was stored on. Without a match, its name below the data folder."""
    plain = portable_path(value)
    if present(plain):
        return plain
    parts = [p for p in PurePosixPath(plain).parts if p != "/" and not p.endswith(":/")]
    for i in range(len(parts)):
        candidate = f"{data_dir.rstrip('/')}/{'/'.join(parts[i:])}"
        if present(candidate):
            return candidate
    return f"{data_dir.rstrip('/')}/{parts[-1] if parts else ''}"


def fingerprint(df: DataFrame) -> str:
    """A digest of what a file-backed table reads: path, length and modification time of each of its files.

    Tasks look at the files; one row comes to the driver. No column is read.
    """
    m = F.col("_metadata")
    files = df.select(m["file_path"].alias("path"), m["file_size"].alias("size"), m["file_modification_time"].alias("time")).distinct()
    h = F.xxhash64("path", "size", "time")
    row = files.agg(F.count("*"), F.bit_xor(h), F.bit_xor(F.xxhash64(h))).first()
    return hashlib.sha256(json.dumps(list(row)).encode()).hexdigest()[:16]


# ---------------------------------------------------------------- versions


def versions(spark: SparkSession, path: str) -> list[tuple[int, str, bool]]:
    """(number, folder, whether it is whole) of the versions below path, the oldest first."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
    found = sorted((int(n[1:10]), f"{path}/{n}") for n in names if n[:1] == "v" and n[1:10].isdigit())
    return [(number, folder, exists(spark, f"{folder}/meta/_SUCCESS")) for number, folder in found]


def current_version(spark: SparkSession, path: str) -> str | None:
    """Folder of the newest whole version below path; None where there is none.

    A version is whole once its last table, meta, has been committed; nothing is ever written into it afterwards, so who has
    looked it up reads it to the end while newer ones are built beside it.
    """
    return next((folder for _, folder, whole in reversed(versions(spark, path)) if whole), None)


def new_version(spark: SparkSession, path: str) -> str:
    """Folder for the next version below path. Versions before the newest two whole ones are removed, and what was left half
    done before them."""
    have = versions(spark, path)
    kept = [number for number, _, whole in have if whole][-2:]
    for number, folder, _ in have:
        if len(kept) == 2 and number < kept[0]:
            p = spark._jvm.org.apache.hadoop.fs.Path(folder)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return f"{path}/v{1 + max((number for number, _, _ in have), default=0):09d}-{uuid.uuid4().hex[:8]}"
