"""Articles in JATS XML as plain text: one pass over the parser's events, block by block in reading order."""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: elements that are one block of text, that float beside the text, and that carry no claim
BLOCKS = frozenset({"p", "title", "article-title", "subtitle", "label", "caption", "attrib", "disp-quote", "speech", "statement", "verse-group", "def-item", "list-item", "td", "th"})
FLOATS = frozenset({"table-wrap", "fig", "fig-group", "boxed-text", "list", "def-list"})
SKIPPED = frozenset(
    {"ref-list", "ref", "back-matter", "journal-meta", "permissions", "funding-group", "contrib-group", "aff", "author-notes", "pub-date", "history", "kwd-group", "counts", "custom-meta-group", "processing-meta", "xref", "fn-group"}
)
SECTIONS = ("article-title", "abstract", "body", "floats-group")
IMAGE_ONLY = "[table not machine-readable: published as an image]"
#: Why bytes give no text.
REFUSALS = ("no_xml", "no_article", "no_text")


class Block:
    """An open element that becomes one block. What floats in it comes after it."""

    def __init__(self) -> None:
        self.text: list[str] = []
        self.after: list[str] = []

    def own(self) -> str:
        return " ".join("".join(self.text).split())


class Table:
    """An open table-wrap: its first label and caption, a line for each row in the order in which rows begin."""

    def __init__(self) -> None:
        self.heads: dict[str, str] = {}
        self.rows: list[list[str]] = []
        self.image = False

    def lines(self) -> list[str]:
        rows = [" | ".join(filter(None, cells)) for cells in self.rows]
        heads = [self.heads[k] for k in ("label", "caption") if self.heads.get(k)]
        return [*heads, *filter(None, rows), *([IMAGE_ONLY] if self.image and not any(rows) else [])]


class Reader:
    """Handlers of one article's events.

    `open` holds what collects text now: blocks, tables, rows' cells, None for a float that starts anew inside a block.
    Skipped subtrees are counted, not entered.
    """

    def __init__(self) -> None:
        self.sections: dict[str, list[str]] = {}
        self.names: list[str] = []
        self.open: list[tuple[int, object]] = []
        self.article = 0
        self.done = False
        self.section: tuple[str, int] | None = None
        self.skipped = 0

    def start(self, name: str, _: object) -> None:
        tag = name.rsplit("}", 1)[-1].lower()
        self.names.append(tag)
        depth = len(self.names)
        if self.done:
            return
        if not self.article:
            self.article = depth if tag == "article" else 0
            return
        if self.section is None:
            titled = tag != "article-title" or self.names[-2] == "title-group"
            if tag in SECTIONS and titled and tag not in self.sections:
                self.section, self.sections[tag] = (tag, depth), []
                if tag == "article-title":
                    self.open.append((depth, Block()))
            return
        if self.skipped or tag in SKIPPED:
            self.skipped += 1
            return
        top = self.open[-1][1] if self.open else None
        table = next((x for _, x in reversed(self.open) if isinstance(x, Table)), None)
        if tag == "table-wrap":
            self.open.append((depth, Table()))
        elif tag in FLOATS:
            self.open.append((depth, None))
        elif isinstance(top, (Table, list)) or (table is not None and isinstance(top, Block)):
            self._inside_table(tag, depth, top, table)
        elif tag in BLOCKS and not isinstance(top, Block):
            self.open.append((depth, Block()))

    def _inside_table(self, tag: str, depth: int, top: object, table: Table) -> None:
        if tag == "tr":
            table.rows.append([])
            self.open.append((depth, table.rows[-1]))
        elif tag in ("td", "th") and isinstance(top, list):
            self.open.append((depth, Block()))
        elif tag in ("label", "caption") and isinstance(top, Table) and tag not in table.heads:
            table.heads[tag] = ""
            self.open.append((depth, Block()))
        elif tag == "graphic":
            table.image = True

    def data(self, text: str) -> None:
        if self.section is None or self.skipped:
            return
        # a cell's text is also that of the cells around it, as far as no float lies between
        for _, x in reversed(self.open):
            if isinstance(x, Block):
                x.text.append(text)
            elif not isinstance(x, list):
                return

    def end(self, _: str) -> None:
        depth, tag = len(self.names), self.names.pop()
        if self.done or not self.article:
            return
        if self.skipped:
            self.skipped -= 1
            return
        if self.open and self.open[-1][0] == depth:
            self._close(tag, self.open.pop()[1])
        if self.section and self.section[1] == depth:
            self.section = None
        if depth == self.article:
            self.done = True

    def _close(self, tag: str, x: object) -> None:
        outer = self.open[-1][1] if self.open else None
        if isinstance(x, Table):
            self._sink().extend(x.lines())
        elif isinstance(x, Block) and isinstance(outer, list):
            outer.append(x.own())
        elif isinstance(x, Block) and isinstance(outer, Table):
            outer.heads[tag] = x.own()
        elif isinstance(x, Block):
            self._sink().extend([*filter(None, [x.own()]), *x.after])

    def _sink(self) -> list[str]:
        """Where a block goes that has just ended: after the block that it floats in, else to the section."""
        return next((x.after for _, x in reversed(self.open) if isinstance(x, Block)), self.sections[self.section[0]])


def article_text(data: bytes) -> tuple[str | None, str | None]:
    """(text, refusal) of an article: title, abstract, body and floats as blocks with empty lines between.

    Inline markup closes up and white space collapses; tables and figures inside a paragraph come after it; a table is
    its label, its caption and a line for each row, cells joined by ' | '. A block equal to the one before it is left
    out. Bytes that are no XML, no article or without any text are refused.
    """
    reader = Reader()
    parser = expat.ParserCreate(namespace_separator="}")
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = reader.start, reader.end, reader.data
    try:
        parser.Parse(data, True)
    except (expat.ExpatError, ValueError):
        return None, REFUSALS[0]
    if not reader.article:
        return None, REFUSALS[1]
    blocks = [b for s in SECTIONS for b in reader.sections.get(s, ())]
    kept = [b for i, b in enumerate(blocks) if not i or b != blocks[i - 1]]
    return ("\n\n".join(kept), None) if kept else (None, REFUSALS[2])


def article_texts(df: DataFrame, key: str, data: str) -> DataFrame:
    """(key, text, refusal) of XML in a column of strings or bytes; null counts as no XML."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [article_text(x.encode() if isinstance(x, str) else x or b"") for x in batch.column(1).to_pylist()]
            texts, refusals = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(refusals, pa.string())], names=[key, "text", "refusal"])

    return df.select(key, data).mapInArrow(run, f"`{key}` {kind}, text string, refusal string")


def read_articles(spark: SparkSession, path: str, glob: str = "*.xml") -> DataFrame:
    """(path, text, refusal) of the XML files below a path; files are dealt to tasks, each is one article."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return article_texts(files.select(F.col("path"), "content"), "path", "content")
