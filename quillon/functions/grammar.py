"""Grammars of declared genotypes and constructs, as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.sections import let

#: Both signs that papers write for a deletion (fixed values).
_DELTA, _GENE = "[\u0394\u2206]", "[A-Za-z][A-Za-z0-9_-]*"
#: The notation of each kind of part; the first that fits decides.
NOTATION = (
    ("deletion_with_insertion", f"^{_DELTA}\\s*({_GENE})\\s*::\\s*([A-Za-z0-9_.-]+)$"),
    ("deletion_with_detail", f"^{_DELTA}\\s*({_GENE})\\s*\\((.+)\\)$"),
    ("deletion", f"^{_DELTA}\\s*({_GENE})$"),
    ("deletion_after", f"^({_GENE})\\s*{_DELTA}$"),
    ("plasmid", "^(p[A-Z][A-Za-z0-9]*)(?:-(.+))?$"),
    ("bare", "^([A-Za-z][A-Za-z0-9_.-]*)$"),
)
#: Separators outside brackets, which may nest once.
_SEPARATOR = "[;/](?!(?:[^()]|\\([^()]*\\))*\\))"


def _part(token: Column, first: Column) -> Column:
    """(as_reported, kind, target, inserted, detail, carries) of one token; unparsed keeps the token visible."""
    kind = F.lit("unparsed")
    for name, pattern in reversed(NOTATION):
        kind = F.when(token.rlike(pattern), name).otherwise(kind)

    def told(kind: Column) -> Column:
        group = lambda i: F.coalesce(*(F.when(kind == name, F.nullif(F.regexp_extract(token, pattern, i), F.lit(""))) for name, pattern in NOTATION if i == 1 or name in ("deletion_with_insertion", "deletion_with_detail", "plasmid")))
        shown = F.when(kind == "bare", F.when(first, "background").otherwise("marker")).when(kind.startswith("deletion") & (kind != "deletion_with_insertion"), "deletion").otherwise(kind)
        second = group(2)
        carries = F.when((kind == "plasmid") & second.isNotNull(), F.split(second, "-")).otherwise(F.array().cast("array<string>"))
        return F.struct(
            token.alias("as_reported"), shown.alias("kind"), group(1).alias("target"), F.when(kind == "deletion_with_insertion", second).alias("inserted"),
            F.when(kind == "deletion_with_detail", F.trim(second)).alias("detail"), carries.alias("carries"),
        )

    return let(kind, told)


def parse_genotype(genotype: Column) -> Column:
    """Parts of a reported genotype. Tokens stand between `;` and `/` outside brackets; the first bare one is the
    background. A token that fits nothing is split at blanks if one half is a deletion or a plasmid, else unparsed."""
    tokens = F.filter(F.transform(F.split(genotype, _SEPARATOR), lambda x: F.trim(x)), lambda x: x != "")
    tokens = F.transform(tokens, lambda x, i: F.struct(x.alias("t"), (i == 0).alias("first")))

    def parts(x: Column) -> Column:
        return let(_part(x["t"], x["first"]), lambda whole: told(x, whole))

    def told(x: Column, whole: Column) -> Column:
        halves = F.transform(F.split(x["t"], "\\s+"), lambda y, i: _part(y, x["first"] & (i == 0)))
        some = lambda h: (F.size(h) > 1) & F.exists(h, lambda p: p["kind"].isin("deletion", "deletion_with_insertion", "plasmid"))
        return F.when(whole["kind"] == "unparsed", let(halves, lambda h: F.when(some(h), h).otherwise(F.array(whole)))).otherwise(F.array(whole))

    return F.flatten(F.transform(tokens, parts))


def deletions(parts: Column) -> Column:
    """Genes that a genotype deletes, in upper case."""
    return F.transform(F.filter(parts, lambda p: p["kind"].isin("deletion", "deletion_with_insertion")), lambda p: F.upper(p["target"]))


#: Gene and organism that a construct's prefix names; tags of the matrix, with the typos that deposits have.
CONSTRUCT_GENES = {
    "ScILV2": ("ILV2", "Saccharomyces cerevisiae"),
    "ScILV3": ("ILV3", "Saccharomyces cerevisiae"),
    "ScILV5": ("ILV5", "Saccharomyces cerevisiae"),
    "ScARO10": ("ARO10", "Saccharomyces cerevisiae"),
    "LlAdhA": ("adhA", "Lactococcus lactis"),
    "LlKivd": ("kivd", "Lactococcus lactis"),
    "EcIlvC": ("ilvC", "Escherichia coli"),
    "EcIlvD": ("ilvD", "Escherichia coli"),
}
MATRIX_TAGS = ("CoxIV", "CovIV", "COXIV", "CoxIv")
_TRUNCATED = "^([A-Za-z]{2}[A-Za-z0-9]+?)N(\\d{1,3})$"


def parse_construct(genotype: Column, native: Mapping[str, str], genes: Mapping[str, tuple[str, str]] = CONSTRUCT_GENES, tags: Sequence[str] = MATRIX_TAGS, host: str = "Saccharomyces cerevisiae") -> Column:
    """(gene, organism, place, token, truncated) of each gene that a declared construct names; the last mention counts.

    A tag in the token means the matrix. A truncation moves a gene that is natively in the matrix to the cytosol and
    leaves others where they are. A gene of another organism is cytosolic; else its native place, or unknown.
    """
    tokens = F.split(genotype, "[_\\s;,]+")
    tagged = lambda t: F.exists(F.array(*map(F.lit, tags)), lambda x: F.contains(t, x))
    cores = F.flatten(F.transform(tokens, lambda t: F.transform(F.split(t, "-"), lambda c: F.struct(F.trim(c).alias("core"), tagged(t).alias("tagged")))))

    def gene(x: Column) -> Column:
        cut = F.nullif(F.regexp_extract(x["core"], _TRUNCATED, 2), F.lit("")).cast("int")
        return let(cut, lambda cut: let(F.when(cut.isNotNull(), F.regexp_extract(x["core"], _TRUNCATED, 1)).otherwise(x["core"]), lambda base: let(called(base), lambda found: placed(x, cut, found))))

    def called(base: Column) -> Column:
        found = F.lit(None).cast("struct<gene:string,organism:string,home:string>")
        for key, (symbol, organism) in reversed(genes.items()):
            one = F.struct(F.lit(symbol).alias("gene"), F.lit(organism).alias("organism"), F.lit(native.get(symbol)).cast("string").alias("home"))
            found = F.when(base.startswith(key), one).otherwise(found)
        return found

    def placed(x: Column, cut: Column, found: Column) -> Column:
        home = F.coalesce(found["home"], F.lit("unknown"))
        place = F.when(x["tagged"], "mitochondrial_matrix").when(cut.isNotNull() & (home == "mitochondrial_matrix"), "cytosol").when(cut.isNotNull(), home).when(found["organism"] != host, "cytosol").otherwise(home)
        return F.struct(found["gene"].alias("gene"), found["organism"].alias("organism"), place.alias("place"), x["core"].alias("token"), cut.alias("truncated"))

    named = F.filter(F.transform(cores, gene), lambda g: g["gene"].isNotNull())
    last = lambda n: F.filter(n, lambda g, i: ~F.exists(F.slice(n, i + 2, F.size(n)), lambda h: h["gene"] == g["gene"]))
    return F.array_sort(let(named, last))


def parent(genotype: Column) -> Column:
    """The strain that a construct was put in: `NAME with ...`."""
    return F.nullif(F.regexp_extract(genotype, "^\\s*([A-Za-z0-9._-]+)\\s+with\\b", 1), F.lit(""))
