"""Text functions as Column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def tokens(c: Column) -> Column:
    """Lower-cased [a-z0-9]+ runs."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def find_all(haystack: Column, needle: Column) -> Column:
    """Offsets, from 0, of all occurrences, also those that overlap; none for an empty needle.

    The text is split in front of every occurrence, in one pass; offsets are the running lengths of the pieces.
    """
    quoted = F.concat(F.lit("(?=\\Q"), F.replace(needle, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)"))
    pieces = F.split(haystack, quoted)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found"))
    ends = F.aggregate(pieces, start, lambda acc, x: F.struct((acc["at"] + F.length(x)).alias("at"), F.concat(acc["found"], F.array(acc["at"])).alias("found")), lambda acc: acc["found"])
    first = F.when(F.startswith(haystack, needle), 1).otherwise(2)
    return F.when(F.length(needle) == 0, F.array().cast("array<int>")).otherwise(F.slice(ends, first, F.size(ends)))


def normalize_title(c: Column) -> Column:
    """Lower case, punctuation as spaces, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "[^\\p{L}\\p{N}\\s]", " "), "\\s+", " "))


def slug(c: Column) -> Column:
    """Lower case with dashes for all else but letters and digits."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-|-$", "")


def collapse(c: Column) -> Column:
    """White space runs as one space."""
    return F.trim(F.regexp_replace(c, "\\s+", " "))


#: Signs that papers print in several ways, and the one they are compared as.
FOLD = {"‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "―": "-", "−": "-", "‘": "'", "’": "'", "“": '"', "”": '"', "×": "x"}


_FOLDED = str.maketrans(FOLD)


@F.udf(T.StringType(), useArrow=False)
def nfkc(x: str | None) -> str | None:
    """Compatibility normal form, dashes and quotes folded, case folded, white space collapsed.

    Row by row: a batch of Arrow holds 10,000 texts, however long they are.
    """
    return None if x is None else " ".join(unicodedata.normalize("NFKC", x).translate(_FOLDED).split()).casefold()


#: Words that don't tell one title from another.
TITLE_STOPWORDS = (
    "a an and as at by during for from in into is its of on or the to via with using "
    "effect effects role roles study studies analysis production yeast saccharomyces cerevisiae"
).split()


def title_overlap(title: Column, opening: Column) -> Column:
    """Share of a title's distinctive words that a document's opening text holds; null where the title has fewer than
    three or the text is blank, as the check then can't be run."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(title), F.lit("[a-z][a-z0-9-]{3,}"), F.lit(0)))
    wanted = F.array_except(words, F.array(*map(F.lit, TITLE_STOPWORDS)))
    found = F.size(F.filter(wanted, lambda w: F.contains(F.lower(opening), w)))
    return F.when((F.size(wanted) >= 3) & (F.trim(opening) != ""), found / F.size(wanted))


def hours(declared: Column) -> Column:
    """The clock reading that a declared time point states: `hour 26` before `26 h`; null where it states none."""
    first = F.regexp_extract(declared, "(?i)hour\\s*(\\d+(?:\\.\\d+)?)", 1)
    second = F.regexp_extract(declared, "(?i)(\\d+(?:\\.\\d+)?)\\s*(?:h|hr|hour)s?\\b", 1)
    return F.coalesce(F.nullif(first, F.lit("")), F.nullif(second, F.lit(""))).try_cast("double")


def licence_class(licence: Column, permissive: tuple[str, ...] = ("cc0", "public-domain")) -> Column:
    """Whether a licence lets texts be mined: yes, no or unknown, which also a non-commercial one is."""
    plain = F.regexp_replace(F.lower(F.trim(licence)), "[\\s_]+", "-")
    named = F.lit(False)
    for p in permissive:
        named = named | plain.contains(p)
    no_changes = plain.contains("-nd") | plain.contains("noderiv")
    no_trade = plain.contains("-nc") | plain.contains("noncommercial")
    verdict = F.when(named, "yes").when(~plain.contains("cc-by"), "unknown").when(no_changes, "no").when(no_trade, "unknown").otherwise("yes")
    return F.when(F.coalesce(licence, F.lit("")) == "", "unknown").otherwise(verdict)


#: Spellings of one unit.
UNIT_SPELLINGS = {
    "g/l": ("g/l", "g l-1", "gl-1", "g.l-1", "grams per liter", "grams per litre"),
    "mg/l": ("mg/l", "mg l-1", "mgl-1", "mg.l-1"),
    "g/g": ("g/g", "g g-1", "gg-1"),
    "mg/g": ("mg/g", "mg g-1", "mgg-1"),
    "%": ("%", "percent"),
    "h": ("h", "hour", "hours", "hr"),
}


def names_number(quote: Column, value: Column) -> Column:
    """Whether a quote has a number in a spelling that a paper may print: as given, without trailing zeros, with `.0` if
    it is whole. What is no number isn't found."""
    number = value.try_cast("double")
    plain = F.regexp_replace(F.format_string("%.10f", number), "\\.?0+$", "")
    whole = F.when(number == F.floor(number), F.concat(F.floor(number).cast("string"), F.lit(".0")))
    found = F.contains(quote, value.cast("string")) | F.contains(quote, plain) | F.coalesce(F.contains(quote, whole), F.lit(False))
    return number.isNotNull() & F.coalesce(found, F.lit(False))


def names_unit(quote: Column, unit: Column) -> Column:
    """Whether a quote, already folded, names a unit in one of its spellings."""
    claimed, out = nfkc(unit), F.lit(False)
    known = F.lit(False)
    for spellings in UNIT_SPELLINGS.values():
        mine, there = claimed.isin(*spellings), F.lit(False)
        for s in spellings:
            there = there | quote.contains(s)
        known, out = known | mine, out | (mine & there)
    return F.when(known, out).otherwise((F.length(claimed) > 0) & F.contains(quote, claimed))


def distinguishing(value: Column) -> Column:
    """Whether a name would tell one subject from others: a bare number, which may be a year, doesn't."""
    return ~F.trim(value).rlike("^\\d+$")


def names_one_thing(value: Column) -> Column:
    """Whether a field names one subject rather than a list of them."""
    parts = F.filter(F.split(value, ",|\\band\\b|\\bor\\b|/"), lambda x: F.length(F.trim(x)) >= 3)
    return F.size(parts) <= 1


def three_state(c: Column) -> Column:
    """(value, absence): NULL was never recorded, 'NA' doesn't apply, 'unknown' was recorded and is unresolved."""
    absence = F.when(c.isNull(), "not_recorded").when(c == "NA", "not_applicable").when(c == "unknown", "unknown")
    return F.struct(F.when(absence.isNull(), c).alias("value"), absence.alias("absence"))


def span_verdict(text: Column, start: Column, quote: Column) -> Column:
    """Whether a quote stands where it is said to: exact, moved, ambiguous, absent, or no text."""
    n = F.size(find_all(text, quote))
    here = F.substr(text, start + 1, F.length(quote)) == quote
    return F.when(text.isNull(), "no_text").when(here, "exact").when(n == 1, "moved").when(n > 1, "ambiguous").otherwise("absent")
