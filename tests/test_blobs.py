"""Blobs lie under their checksums; nothing is written twice or half; texts are read by publication."""

from __future__ import annotations

import hashlib
import os

import pytest
from pyarrow import fs as pafs

from quillon.sources import blobs as B


def files(root):
    return sorted(f for d, _, names in os.walk(f"{root}/fulltext") for f in names)


def test_a_second_run_writes_nothing(spark, tmp_path):
    root = f"file://{tmp_path}"
    rows = [(1, "alpha", "text/plain; charset=utf-8"), (2, "alpha", "text/plain"), (3, "<p>x</p>", "text/html"), (4, None, "text/html"), (5, "", None)]
    df = spark.createDataFrame(rows, "id int, body string, kind string").repartition(3)
    first = {r.id: r for r in B.store_blobs(df, "id", "body", "kind", root).collect()}
    digest = hashlib.sha256(b"alpha").hexdigest()
    assert set(first) == {1, 2, 3, 5} and first[1].path == first[2].path == f"fulltext/{digest[:2]}/{digest}.txt" and first[5].path.endswith(".bin")
    assert len(files(tmp_path)) == 3 and open(f"{tmp_path}/{first[1].path}").read() == "alpha"
    before = {f: os.stat(f"{tmp_path}/{r.path}").st_mtime_ns for f, r in first.items()}
    again = B.store_blobs(df, "id", "body", "kind", root).collect()
    assert not any(r.written for r in again) and before == {f: os.stat(f"{tmp_path}/{r.path}").st_mtime_ns for f, r in first.items()}


def test_a_lost_task_leaves_no_half_file(tmp_path, monkeypatch):
    local = pafs.LocalFileSystem()
    target = f"{tmp_path}/fulltext/ab/abc.txt"

    class Dies:
        """The file system, whose streams break after half of the bytes."""

        def __getattr__(self, name):
            return getattr(local, name)

        def open_output_stream(self, path):
            stream = local.open_output_stream(path)

            class Half:
                def __enter__(self):
                    return self

                def __exit__(self, *_):
                    stream.close()

                def write(self, data):
                    stream.write(data[: len(data) // 2])
                    raise OSError("executor lost")

            return Half()

    with pytest.raises(OSError):
        B.put(Dies(), target, b"whole content")
    assert files(tmp_path) == []
    assert B.put(local, target, b"whole content") and not B.put(local, target, b"whole content")
    assert files(tmp_path) == ["abc.txt"]


def test_texts_by_publication(spark, tmp_path):
    root = f"file://{tmp_path}"
    jats, pdf, latin = b"<article><body><p>Claim.</p></body></article>", b"%PDF-1.7 x", "é".encode("latin-1")
    data = [("a", b"old", "text/plain", 1), ("a", jats, "application/xml", 2), ("b", pdf, "application/pdf", 1), ("c", latin, "text/plain", 1), ("d", b"fine", "text/plain", 1), ("e", b"gone", "text/plain", 1), ("f", b"true", "text/plain", 1), ("g", b"<article/>", "application/xml", 1)]
    df = spark.createDataFrame([(f"doi:10.1/{p}|{at}", bytearray(x), m) for p, x, m, at in data], "key string, body binary, kind string")
    stored = {r.key: r for r in B.store_blobs(df, "key", "body", "kind", root).collect()}
    assets = [(f"doi:10.1/{p}", r.path, r.checksum, m, "stored_fulltext", at) for p, _, m, at in data for r in [stored[f"doi:10.1/{p}|{at}"]]]
    assets.append(("doi:10.1/d", "fulltext/xx/none.txt", "0", "text/plain", "link_only", 9))
    os.remove(f"{tmp_path}/{stored['doi:10.1/e|1'].path}")
    with open(f"{tmp_path}/{stored['doi:10.1/f|1'].path}", "wb") as f:
        f.write(b"false")
    table = spark.createDataFrame(assets, "publication_id string, path string, checksum string, media_type string, state string, retrieved_at int")
    wanted = spark.createDataFrame([(f"DOI:10.1/{p.upper()}",) for p in "abcdefgh"], "publication_id string")
    got = {r.publication_id[-1]: (r.text, r.refusal) for r in B.source_texts(wanted, table, root).collect()}
    assert got == {"A": ("Claim.", None), "B": (None, "pdf"), "C": (None, "not_utf8"), "D": ("fine", None), "E": (None, "missing_file"), "F": (None, "altered"), "G": (None, "jats_unreadable"), "H": (None, "no_asset")}
