"""A content-addressed store: blobs lie under their own checksum, written by tasks and never changed."""

from __future__ import annotations

import hashlib
import posixpath
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.sources.jats import article_text

#: File endings by media type; the state of an asset that holds a full text.
ENDINGS = {"application/pdf": ".pdf", "application/xml": ".xml", "text/xml": ".xml", "text/html": ".html", "text/plain": ".txt"}
STORED = "stored_fulltext"
#: Why an asset gives no text.
REFUSALS = ("no_asset", "missing_file", "altered", "jats_unreadable", "pdf", "not_utf8")


def blob_path(checksum: str, media_type: str | None, folder: str = "fulltext") -> str:
    """Relative path of a blob; media types may carry parameters, unknown ones end in .bin."""
    kind = (media_type or "").split(";", 1)[0].strip().lower()
    return f"{folder}/{checksum[:2]}/{checksum}{ENDINGS.get(kind, '.bin')}"


def put(fs: pafs.FileSystem, path: str, data: bytes) -> bool:
    """Write a file unless it is there; whether it was written.

    It is written under a name of its own and then renamed, so a task that dies leaves no half file under the final name,
    and tasks that write the same blob at once leave one whole file.
    """
    if fs.get_file_info(path).type == pafs.FileType.File:
        return False
    fs.create_dir(posixpath.dirname(path), recursive=True)
    temporary = f"{path}.{uuid.uuid4().hex}.part"
    try:
        with fs.open_output_stream(temporary) as out:
            out.write(data)
        fs.move(temporary, path)
    except BaseException:
        if fs.get_file_info(temporary).type == pafs.FileType.File:
            fs.delete_file(temporary)
        raise
    return True


def store_blobs(df: DataFrame, key: str, data: str, media_type: str, root: str) -> DataFrame:
    """(key, checksum, path, size, written) of df's blobs (strings or bytes), once they are stored below root.

    Contents never leave the task that has them. A blob that is there already isn't written again. Null data have no
    blob and are left out; root is a URI that all executors reach.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(root)
        for batch in batches:
            rows = []
            for k, x, m in zip(*(batch.column(i).to_pylist() for i in range(3))):
                raw = x.encode() if isinstance(x, str) else x
                checksum = hashlib.sha256(raw).hexdigest()
                path = blob_path(checksum, m)
                rows.append((k, checksum, path, len(raw), put(fs, f"{base}/{path}", raw)))
            columns = list(zip(*rows)) or [()] * 5
            arrays = [pa.array(c, t) for c, t in zip(columns, (batch.schema.field(0).type, pa.string(), pa.string(), pa.int64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays(arrays, names=[key, "checksum", "path", "size", "written"])

    have = df.where(F.col(data).isNotNull()).select(key, data, media_type)
    manifest = f"{root}/manifests/{uuid.uuid4().hex}"
    have.mapInArrow(run, f"`{key}` {kind}, checksum string, path string, size long, written boolean").write.parquet(manifest)
    return df.sparkSession.read.parquet(manifest)


def decode(data: bytes, media_type: str | None) -> tuple[str | None, str | None]:
    """(text, refusal) of a blob: an article's text, or what is UTF-8; nothing is decoded with replacements."""
    text, refusal = article_text(data)
    if text is not None:
        return text, None
    if refusal == "no_text":
        return None, "jats_unreadable"
    if data[:5] == b"%PDF-" or (media_type or "").split(";", 1)[0].strip().lower() == "application/pdf":
        return None, "pdf"
    try:
        return data.decode(), None
    except UnicodeDecodeError:
        return None, "not_utf8"


def source_texts(wanted: DataFrame, assets: DataFrame, root: str) -> DataFrame:
    """(publication_id, path, text, refusal) of every wanted publication, from its newest stored asset.

    assets are (publication_id, path, checksum, media_type, state, retrieved_at); ids are compared case-folded; of
    assets of one time the greatest path is taken. Only the files that are asked for are read, by the tasks. A
    publication without a stored asset, a file that isn't there or isn't what its checksum says, and bytes that aren't
    text are refused, each by name.
    """
    newest = F.max_by(F.struct("path", "checksum", "media_type"), F.struct("retrieved_at", "path")).alias("a")
    best = assets.where(F.col("state") == STORED).groupBy(F.lower("publication_id").alias("_id")).agg(newest)
    asked = wanted.select("publication_id", F.lower("publication_id").alias("_id")).join(best, "_id", "left").select("publication_id", "a.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(root)
        for batch in batches:
            rows = []
            for key, path, checksum, media_type in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if path is None:
                    rows.append((key, None, None, "no_asset"))
                    continue
                try:
                    with fs.open_input_stream(f"{base}/{path}") as f:
                        data = f.read()
                except FileNotFoundError:
                    rows.append((key, path, None, "missing_file"))
                    continue
                rows.append((key, path, *((None, "altered") if hashlib.sha256(data).hexdigest() != checksum else decode(data, media_type))))
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["publication_id", "path", "text", "refusal"])

    return asked.mapInArrow(run, "publication_id string, path string, text string, refusal string")
