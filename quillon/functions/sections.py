"""Sections of a paper's text, and excerpts whose offsets lead back to it, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a heading line, lower-cased, says for each section; the first that fits names it.
HEADINGS = (
    ("results_and_discussion", "results?\\s+and\\s+discussions?"),
    ("methods", "(?:materials?\\s+and\\s+)?methods?"),
    ("methods", "methods?\\s+and\\s+materials?"),
    ("methods", "experimental(?:\\s+(?:procedures?|section|methods?|details?))?"),
    ("results", "results?"),
    ("discussion", "discussions?"),
    ("abstract", "(?:abstract|summary)"),
    ("introduction", "(?:introduction|background)"),
    ("conclusion", "(?:conclusions?|concluding\\s+remarks)"),
    ("acknowledgements", "acknowledge?ments?"),
    ("references", "(?:references?|bibliography|literature\\s+cited)"),
    ("supplementary", "supplement(?:ary|al)(?:\\s+\\w+)*"),
)
#: Parts that a structured abstract has, those that a body opens with, and the most characters of a part
#: and of the whole abstract.
ABSTRACT_PARTS = ("abstract", "introduction", "methods", "results", "results_and_discussion", "discussion", "conclusion")
BODY_OPENERS = ("introduction", "methods", "results", "results_and_discussion")
PART_CHARS, ABSTRACT_CHARS = 2000, 6000
#: Sections that only a research report has, and those that a review has too.
RESEARCH, NARRATIVE = ("methods", "results", "results_and_discussion"), ("abstract", "introduction", "conclusion", "discussion")

#: A heading fills a line: numbered, as a markdown heading or emphasised, with a colon, or plain.
_BEFORE = "[ \\t]*(?:#{1,6}[ \\t]*)?(?:\\d+(?:\\.\\d+)*[.)]?[ \\t]*)?\\*{0,2}"
_AFTER = "[ \\t.]*\\*{0,2}[ \\t]*:?[ \\t]*"
_ANY = "|".join(f"(?:{p})" for _, p in HEADINGS).replace("\\s", "[ \\t]")
SECTION = "struct<name:string,start:int,end:int,heading:string>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _named(line: Column) -> Column:
    """Section that a heading line opens; most lines aren't short enough to be one."""
    name = F.lit(None).cast("string")
    for section, pattern in reversed(HEADINGS):
        name = F.when(line.rlike(f"(?i)^{_BEFORE}{pattern}{_AFTER}$"), section).otherwise(name)
    return F.when(F.length(line) < 120, name)


def split_sections(text: Column) -> Column:
    """Named sections (name, start, end, heading) that tile a text; each begins at its heading line.

    What stands before the first heading is front_matter; a text without headings is one section, unsectioned. A
    structured abstract, whose first body section opens again further down, becomes one section.
    """
    pieces = F.split(text, f"(?imd)(?=^{_BEFORE}(?:{_ANY}){_AFTER}$)")
    line = lambda x: F.regexp_extract(x, "(?d)^[^\\n]*", 0)
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SECTION}>").alias("found"))

    opened = lambda x: let(line(x), lambda y: F.struct(_named(y).alias("name"), y.alias("line"), F.length(x).alias("n")))

    def step(acc: Column, piece: Column) -> Column:
        name, end = piece["name"], acc["at"] + piece["n"]
        heading = F.when(name.isNotNull(), F.trim(F.regexp_replace(piece["line"], f"^{_BEFORE}|\\*{{0,2}}[ \\t]*:?[ \\t]*$", "")))
        one = F.struct(F.coalesce(name, F.lit("front_matter")).alias("name"), acc["at"].alias("start"), end.alias("end"), heading.alias("heading"))
        return F.struct(end.alias("at"), F.when(piece["n"] > 0, F.concat(acc["found"], F.array(one))).otherwise(acc["found"]).alias("found"))

    found = F.aggregate(F.transform(pieces, opened), start, step, lambda acc: acc["found"])
    whole = F.array(F.struct(F.lit("unsectioned").alias("name"), F.lit(0).alias("start"), F.length(text).alias("end"), F.lit(None).cast("string").alias("heading")))
    folded = let(found, lambda f: F.when(F.exists(f, lambda s: s["heading"].isNotNull()), fold_abstract(f)).otherwise(whole))
    return F.when(text.isNotNull(), folded)


def fold_abstract(sections: Column) -> Column:
    """Sections with a leading structured abstract as one section."""
    skip = F.when(F.get(sections, F.lit(0))["name"] == "front_matter", 1).otherwise(0)
    rest = F.slice(sections, skip + 1, F.size(sections))
    zero = F.struct(F.lit(True).alias("open"), F.array().cast("array<string>").alias("seen"), F.lit(0).alias("chars"))

    def step(acc: Column, s: Column) -> Column:
        size = s["end"] - s["start"]
        fits = acc["open"] & s["name"].isin(*ABSTRACT_PARTS) & ~F.array_contains(acc["seen"], s["name"]) & (size <= PART_CHARS) & (acc["chars"] + size <= ABSTRACT_CHARS)
        return F.struct(fits.alias("open"), F.when(fits, F.concat(acc["seen"], F.array(s["name"]))).otherwise(acc["seen"]).alias("seen"), F.when(fits, acc["chars"] + size).otherwise(acc["chars"]).alias("chars"))


    def folded(seen: Column) -> Column:
        n = F.size(seen)
        opener = F.get(F.filter(seen, lambda x: x.isin(*BODY_OPENERS)), F.lit(0))
        after = F.slice(rest, n + 1, F.size(rest))
        one = F.struct(F.lit("abstract").alias("name"), F.get(rest, F.lit(0))["start"].alias("start"), F.get(rest, n - 1)["end"].alias("end"), F.get(rest, F.lit(0))["heading"].alias("heading"))
        opens_again = F.coalesce(F.exists(after, lambda s: s["name"] == opener), F.lit(False))
        return F.when(opens_again, F.concat(F.slice(sections, 1, skip), F.array(one), after)).otherwise(sections)

    return let(F.aggregate(rest, zero, step, lambda acc: acc["seen"]), folded)


def looks_like_review(sections: Column) -> Column:
    """Whether a document has a narrative section but neither methods nor results."""
    names = F.transform(sections, lambda s: s["name"])
    return ~F.arrays_overlap(names, F.array(*map(F.lit, RESEARCH))) & F.arrays_overlap(names, F.array(*map(F.lit, NARRATIVE)))


def excerpt(text: Column, sections: Column, wanted: Sequence[str]) -> Column:
    """(text, pieces) of the wanted sections put together, each after a marker line that is in no piece.

    pieces are (name, doc_start, doc_end, exc_start, exc_end); no wanted section gives an empty text.
    """
    chosen = F.filter(sections, lambda s: s["name"].isin(*wanted))
    marked = F.transform(chosen, lambda s: F.concat(F.lit("[[section: "), s["name"], F.lit("]]\n"), F.substr(text, s["start"] + 1, s["end"] - s["start"])))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<name:string,doc_start:int,doc_end:int,exc_start:int,exc_end:int>>").alias("pieces"))

    def step(acc: Column, s: Column) -> Column:
        begin = acc["at"] + F.when(F.size(acc["pieces"]) > 0, 2).otherwise(0) + F.length(s["name"]) + 14
        end = begin + s["end"] - s["start"]
        piece = F.struct(s["name"].alias("name"), s["start"].alias("doc_start"), s["end"].alias("doc_end"), begin.alias("exc_start"), end.alias("exc_end"))
        return F.struct(end.alias("at"), F.concat(acc["pieces"], F.array(piece)).alias("pieces"))

    return F.struct(F.array_join(marked, "\n\n").alias("text"), F.aggregate(chosen, zero, step, lambda acc: acc["pieces"]).alias("pieces"))


def to_document(pieces: Column, start: Column, end: Column) -> Column:
    """(start, end) in the document of a span of an excerpt; null unless one piece holds all of it."""
    inside = F.get(F.filter(pieces, lambda p: (p["exc_start"] <= start) & (end <= p["exc_end"])), F.lit(0))
    by = inside["doc_start"] - inside["exc_start"]
    return F.when(inside.isNotNull() & (end > start), F.struct((start + by).alias("start"), (end + by).alias("end")))


def windows(text: Column, most: int, overlap: int = 2000) -> Column:
    """Ranges (start, end) of at most `most` characters that cover a text and overlap; a cut prefers the last blank line
    in a window's last quarter."""
    if most <= 0 or not 0 <= overlap < most:
        raise ValueError(f"windows of {most} characters can't overlap by {overlap}")
    least = max(1, most * 3 // 4 - overlap)
    turns = F.sequence(F.lit(0), F.ceil(F.length(text) / least).cast("int"))
    zero = F.struct(F.lit(0).alias("at"), F.lit(False).alias("done"), F.array().cast("array<struct<start:int,end:int>>").alias("found"))

    def step(acc: Column, _: Column) -> Column:
        at, full = acc["at"], F.length(text)
        end = F.least(at + most, full)
        floor = at + most * 3 // 4
        back = F.locate("\n\n", F.reverse(F.substr(text, floor + 1, end - floor)))
        cut = F.when((end < full) & (back > 0), end - back - 1).otherwise(end)
        one = F.concat(acc["found"], F.array(F.struct(at.alias("start"), cut.alias("end"))))
        new = F.struct(F.greatest(cut - overlap, at + 1).alias("at"), (cut >= full).alias("done"), one.alias("found"))
        return F.when(acc["done"], acc).otherwise(new)

    return F.aggregate(turns, zero, step, lambda acc: acc["found"])
