"""Genetic-code functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Amino acids by codon in the order of the bases T, C, A, G, for tables 1 and 3.
BASES = "TCAG"
AMINO_ACIDS = {
    1: "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    3: "FFLLSSSSYY**CCWWTTTTPPPPHHQQRRRRIIMMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
}


def code(table: int) -> dict[str, str]:
    """Amino acid of each codon."""
    codons = [a + b + c for a in BASES for b in BASES for c in BASES]
    return dict(zip(codons, AMINO_ACIDS[table]))


def _lookup(values: dict[str, str], key: Column, otherwise: Column) -> Column:
    pairs = F.create_map(*(F.lit(x) for kv in sorted(values.items()) for x in kv))
    return F.coalesce(F.try_element_at(pairs, key), otherwise)


def codons(seq: Column) -> Column:
    """Whole codons, upper case, U as T."""
    return F.regexp_extract_all(F.replace(F.upper(seq), F.lit("U"), F.lit("T")), F.lit("(?s)..."), F.lit(0))


def translate(seq: Column, table: int, to_stop: bool = False) -> Column:
    """Protein under a table; X for codons that it doesn't have; up to the first stop if asked."""
    protein = F.array_join(F.transform(codons(seq), lambda c: _lookup(code(table), c, F.lit("X"))), "")
    return F.substring_index(protein, "*", 1) if to_stop else protein


def codon_diff(seq: Column, a: int = 1, b: int = 3) -> Column:
    """Codons that two tables read differently: (place from 0, codon)."""
    one, two = code(a), code(b)
    differ = [c for c in sorted(one) if one[c] != two[c]]
    placed = F.transform(codons(seq), lambda c, i: F.struct(i.alias("at"), c.alias("codon")))
    return F.filter(placed, lambda x: x["codon"].isin(*differ))


def at_fraction(seq: Column) -> Column:
    """Share of A and T among the letters; null for an empty sequence."""
    return F.try_divide(F.length(F.regexp_replace(F.upper(seq), "[^AT]", "")), F.length(seq))


#: Codons that native yeast mitochondrial genes don't use.
ABSENT_CODONS = ("CGA", "CGC")
MODES = ("dual_safe", "to_table3", "to_table1")


def recode_map(mode: str = "dual_safe", source_table: int = 1) -> dict[str, str]:
    """For each codon the one to write instead, so that its amino acid under the source table stays.

    A codon that may stay stays, unless it is one of ABSENT_CODONS. Else the codon richest in A and T is taken, absent
    ones last, equals by alphabet. Tables that the amino acid must be read under: both, or one alone.
    """
    if mode not in MODES:
        raise ValueError(f"mode {mode!r} is none of {', '.join(MODES)}")
    under = {"dual_safe": (1, 3), "to_table3": (3,), "to_table1": (1,)}[mode]
    order = sorted(code(1), key=lambda c: (c in ABSENT_CODONS, c.count("G") + c.count("C"), c))
    out = {}
    for c, aa in code(source_table).items():
        fit = [x for x in order if all(code(t)[x] == aa for t in under)]
        out[c] = c if c in fit and c not in ABSENT_CODONS else fit[0]
    return out


def recode(seq: Column, mode: str = "dual_safe", source_table: int = 1) -> Column:
    """Sequence with the same protein in which every codon is read alike under the mode's tables; codons that aren't
    plain A, C, G, T stay as they are."""
    table = recode_map(mode, source_table)
    return F.array_join(F.transform(codons(seq), lambda c: _lookup(table, c, c)), "")


def recode_report(seq: Column, mode: str = "dual_safe", source_table: int = 1) -> Column:
    """(sequence, changed, total, absent_left, internal_stops, ends_in_stop) of a recoded sequence."""
    old, new = codons(seq), codons(recode(seq, mode, source_table))
    changed = F.size(F.filter(F.zip_with(old, new, lambda a, b: a != b), lambda x: x))
    target = code(3 if mode == "to_table3" else 1)
    stops = [c for c in sorted(target) if target[c] == "*"]
    internal = F.size(F.filter(F.slice(new, 1, F.greatest(F.size(new) - 1, F.lit(0))), lambda c: c.isin(*stops)))
    return F.struct(
        F.array_join(new, "").alias("sequence"), changed.alias("changed"), F.size(new).alias("total"),
        F.size(F.filter(new, lambda c: c.isin(*ABSENT_CODONS))).alias("absent_left"), internal.alias("internal_stops"),
        F.coalesce(F.try_element_at(new, F.lit(-1)).isin(*stops), F.lit(False)).alias("ends_in_stop"),
    )


def verify_translation(cds: Column, reference: Column) -> Column:
    """(matches_table3, matches_table1): whether a CDS translates to a reference protein, up to the first stop."""
    return F.struct(*((translate(cds, t, to_stop=True) == reference).alias(f"matches_table{t}") for t in (3, 1)))


def expected_phases(segments: Column) -> Column:
    """Segments (start, end, strand, phase) of a CDS in coding order, each with the phase that those before it ask for.

    Coding order is by start, backwards on the minus strand. The bases before a segment are all of every earlier one
    less the first's own phase; the first segment's phase is taken as it is. Expected is (3 - bases % 3) % 3.
    """
    sign = F.when(F.get(segments, F.lit(0))["strand"] < 0, -1).otherwise(1)
    placed = F.array_sort(F.transform(segments, lambda s: F.struct((s["start"] * sign).alias("place"), s["start"].alias("start"), s["end"].alias("end"), s["phase"].alias("phase"))))

    kinds = "struct<bases:bigint,found:array<struct<start:bigint,end:bigint,phase:int,expected:int>>>"
    zero = F.struct(F.lit(0).cast("long").alias("bases"), F.array().alias("found")).cast(kinds)

    def step(acc: Column, s: Column) -> Column:
        first = F.size(acc["found"]) == 0
        expected = F.when(first, s["phase"]).otherwise(F.pmod(-acc["bases"], F.lit(3)).cast("int"))
        one = F.struct(s["start"].alias("start"), s["end"].alias("end"), s["phase"].alias("phase"), expected.alias("expected"))
        bases = acc["bases"] + s["end"] - s["start"] - F.when(first, s["phase"]).otherwise(0)
        return F.struct(bases.alias("bases"), F.concat(acc["found"], F.array(one)).alias("found")).cast(kinds)

    return F.aggregate(placed, zero, step, lambda acc: acc["found"])


def phase_disagreement(segments: Column) -> Column:
    """The first segment whose declared phase contradicts the lengths before it; null where none does."""
    return F.get(F.filter(expected_phases(segments), lambda s: s["phase"] != s["expected"]), F.lit(0))


def reverse_complement(seq: Column) -> Column:
    """Reverse complement of ACGT; other letters stay."""
    return F.reverse(F.translate(F.upper(seq), "ACGT", "TGCA"))


def splice(seq: Column, segments: Column) -> Column:
    """Segments (start, end) of a sequence, in order of their starts, joined."""
    return F.array_join(F.transform(F.array_sort(segments), lambda s: F.substr(seq, s["start"] + 1, s["end"] - s["start"])), "")


def peptide_verdict(a: Column, b: Column) -> Column:
    """exact, ambiguous (only X differs), internal_stop, or mismatch."""
    n = F.least(F.length(a), F.length(b))
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x == y) | (x == "X") | (y == "X"))
    alike = (F.length(a) == F.length(b)) & F.forall(pairs, lambda x: F.coalesce(x, F.lit(False)))
    return F.when(a == b, "exact").when(F.substr(a, F.lit(1), n - 1).contains("*"), "internal_stop").when(alike, "ambiguous").otherwise("mismatch")


#: The code table of each genome that a compartment's proteins may be encoded in.
GENOME_TABLE = {"nuclear": 1, "mitochondrial": 3}


def table_for(compartment: str, genome: str | None, genomes: dict[str, tuple[str, ...]]) -> int:
    """Code table of a compartment; where two genomes serve it, the genome must be named rather than guessed."""
    choices = genomes.get(compartment)
    if not choices:
        raise ValueError(f"unknown compartment {compartment!r}")
    if genome is None and len(choices) > 1:
        raise ValueError(f"{compartment} is served by {', '.join(choices)}: name the encoding genome")
    if genome is not None and genome not in choices:
        raise ValueError(f"{compartment} has no genes in the {genome} genome")
    return GENOME_TABLE[genome or choices[0]]


def safety(seq: Column, table: int, other: int) -> Column:
    """(safe, codons): codons that another table would read differently, and whether there are none."""
    found = codon_diff(seq, table, other)
    return F.struct((F.size(found) == 0).alias("safe"), found.alias("codons"))


def code_source(annotated: Column, genome: Column, declared: Column) -> Column:
    """(table, source): the CDS's own annotation, else its region's genome, else what is declared; none is a verdict."""
    by_genome = F.try_element_at(F.create_map(*(F.lit(x) for kv in GENOME_TABLE.items() for x in kv)), genome)
    source = F.when(annotated.isNotNull(), "annotation").when(by_genome.isNotNull(), "genome").when(declared.isNotNull(), "declared").otherwise("none")
    return F.struct(F.coalesce(annotated, by_genome, declared).alias("table"), source.alias("source"))
