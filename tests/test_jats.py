"""Reading order, tables, floats and refusals of JATS articles."""

from __future__ import annotations

import pytest

from quillon.sources.jats import IMAGE_ONLY, article_text, read_articles

HEAD = "<front><journal-meta><p>Journal</p></journal-meta><article-meta><title-group><article-title>A <italic>fine</italic>\n title</article-title></title-group>"


def blocks(inside):
    text, refusal = article_text(f"<article>{HEAD}<abstract><p>Short.</p></abstract></article-meta></front>{inside}</article>".encode())
    assert refusal is None
    return text.split("\n\n")[2:]


def test_title_abstract_and_body_in_order():
    text, _ = article_text(f"<article>{HEAD}<abstract><title>Abstract</title><p>One <b>two</b>, three<xref>[1]</xref>.</p></abstract></article-meta></front><body><sec><title>Results</title><p>It holds.</p></sec></body><back><ref-list><ref>gone</ref></ref-list></back></article>".encode())
    assert text == "A fine title\n\nAbstract\n\nOne two, three.\n\nResults\n\nIt holds."


def test_a_table_in_a_paragraph_comes_after_it():
    table = "<table-wrap><label>Table 1</label><caption><p>Titers</p></caption><table><tr><th>strain</th><th>g/L</th></tr><tr><td>IV-1</td><td/><td>1.62</td></tr><tr><td/></tr></table></table-wrap>"
    assert blocks(f"<body><p>Before {table} and after.</p><p>Next</p></body>") == ["Before and after.", "Table 1", "Titers", "strain | g/L", "IV-1 | 1.62", "Next"]


def test_nested_tables_keep_their_rows():
    inner = "<table><tr><td>x</td><td>y</td></tr></table>"
    assert blocks(f"<body><table-wrap><caption>C</caption><table><tr><td>a</td><td>{inner}</td></tr><tr><td>b</td></tr></table></table-wrap></body>") == ["C", "a | xy", "x | y", "b"]


def test_a_table_that_is_an_image_says_so():
    assert blocks("<body><table-wrap><label>T</label><graphic/></table-wrap></body>") == ["T", IMAGE_ONLY]


def test_lists_figures_and_floats_at_the_end():
    assert blocks("<body><p>See <list><list-item><p>one</p></list-item><list-item><p>two</p></list-item></list></p><fig><label>F1</label><caption><title>Cap</title><p>tion</p></caption></fig></body><floats-group><fig><caption><p>Late</p></caption></fig></floats-group>") == ["See", "one", "two", "F1", "Caption", "Late"]


def test_repeats_in_a_row_are_dropped():
    assert blocks("<body><p>same</p><p> same </p><p>other</p><p>same</p></body>") == ["same", "other", "same"]


def test_namespaces_and_an_article_inside_another_root():
    assert article_text(b'<r xmlns="urn:x"><meta/><article><body><p>text &amp; more</p></body></article><article><body><p>second</p></body></article></r>') == ("text & more", None)


@pytest.mark.parametrize(("data", "why"), [(b"", "no_xml"), (b"%PDF-1.4", "no_xml"), (b"<article><body>", "no_xml"), (b"<html><body><p>x</p></body></html>", "no_article"), (b"<article><back><p>x</p></back></article>", "no_text"), (b"<article><body><p> </p></body></article>", "no_text")])
def test_refusals(data, why):
    assert article_text(data) == (None, why)


def test_files_are_read_by_spark(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.xml").write_text("<article><body><p>one</p></body></article>")
    (tmp_path / "sub" / "b.xml").write_text("<nothing/>")
    (tmp_path / "c.txt").write_text("no")
    got = {r.path.rsplit("/", 1)[-1]: (r.text, r.refusal) for r in read_articles(spark, str(tmp_path)).collect()}
    assert got == {"a.xml": ("one", None), "b.xml": (None, "no_article")}
