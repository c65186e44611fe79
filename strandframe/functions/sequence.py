"""Sequence functions as column expressions."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import checked

# IUPAC nucleotide codes, their complements and what they stand for.
CODES = "ACGTRYSWKMBDHVN"
COMPLEMENTS = "TGCAYRSWMKVHDBN"
MEANINGS = {
    "A": "A", "C": "C", "G": "G", "T": "T", "U": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC",
    "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT",
}
DNA, RNA, AMINO_ACIDS = "ACGT", "ACGU", "ACDEFGHIKLMNPQRSTVWY"
ALPHABETS = {"dna": list(DNA + "-"), "rna": list(RNA + "-"), "prot": list(AMINO_ACIDS + "-")}
# The bacterial code (table 11), codons in the order of bases T, C, A, G.
TABLE_11 = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
STARTS_11 = ("TTG", "CTG", "ATT", "ATC", "ATA", "ATG", "GTG")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rna_to_dna(seq) -> Column:
    return F.replace(F.upper(F.trim(_col(seq))), F.lit("U"), F.lit("T"))


def dna_to_rna(seq) -> Column:
    return F.replace(F.upper(F.trim(_col(seq))), F.lit("T"), F.lit("U"))


def reverse_complement(seq) -> Column:
    """Upper-case IUPAC reverse complement; a symbol outside the codes is an error."""
    up = F.upper(_col(seq))
    return checked(F.reverse(F.translate(up, CODES, COMPLEMENTS)), up.rlike(f"^[{CODES}]*$") | up.isNull(), "not an IUPAC nucleotide sequence")


def reverse_complement_lenient(seq) -> Column:
    """Reverse complement that keeps case, gaps and unknown symbols."""
    return F.reverse(F.translate(_col(seq), CODES + CODES.lower() + "Uu", COMPLEMENTS + COMPLEMENTS.lower() + "Aa"))


def degap(seq, gap: str = "-") -> Column:
    return F.replace(_col(seq), F.lit(gap), F.lit(""))


def symbols(seq) -> Column:
    """array<string> of characters; the empty text has none."""
    c = _col(seq)
    return F.when(F.length(c) > 0, F.split(c, "")).otherwise(F.array().cast("array<string>"))


def kmer_array(chars, k: int) -> Column:
    """Overlapping k-mers of a column of characters (symbols()), by indexed concatenation; a shorter one has none.

    The characters must be a column of their own: an expression would be split again for every k-mer."""
    c = _col(chars)
    return F.when(F.size(c) >= k, F.transform(F.sequence(F.lit(0), F.size(c) - k), lambda i: F.concat(*[F.get(c, i + j) for j in range(k)]))).otherwise(F.array().cast("array<string>"))


def pad_right(seq, length, fill: str = "-") -> Column:
    """Filled up to a length; longer texts stay whole."""
    c, n = _col(seq), (F.lit(length) if isinstance(length, int) else length)
    return F.when(F.length(c) < n, F.rpad(c, n, fill)).otherwise(c)


def wrap(seq, width: int) -> Column:
    """Line breaks after every `width` characters, none at the end."""
    return F.regexp_replace(_col(seq), f"(.{{{width}}})(?=.)", "$1\n")


def codon_map() -> Column:
    """map<codon, amino acid> of table 11."""
    bases = "TCAG"
    codons = ["".join(c) for c in product(bases, repeat=3)]
    return F.create_map(*[F.lit(x) for c, a in zip(codons, TABLE_11) for x in (c, a)])


def codons(seq) -> Column:
    """array<string> of whole codons."""
    c = rna_to_dna(seq)
    n = (F.length(c) / 3).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(c, i * 3 + 1, F.lit(3)))).otherwise(F.array().cast("array<string>"))


def translate_codons(seq, unknown: str = "X", gap: str = "-") -> Column:
    """Protein of a coding sequence by table 11; whole-gap codons stay gaps, others unknown are X."""
    table = codon_map()
    one = lambda c: F.coalesce(F.try_element_at(table, c), F.when(c == gap * 3, F.lit(gap)), F.lit(unknown))
    return F.array_join(F.transform(codons(seq), one), "")


def degenerate_regex(primer) -> Column:
    """A primer as a regular expression with bracket classes."""
    one = F.create_map(*[F.lit(x) for k, v in MEANINGS.items() for x in (k, v if len(v) == 1 else f"[{v}]")])
    return F.array_join(F.transform(symbols(F.upper(_col(primer))), lambda c: F.coalesce(F.try_element_at(one, c), c)), "")


def expand_degenerate(primer) -> Column:
    """array<string> of all concrete sequences of a primer, in order."""
    means = F.create_map(*[x for k, v in MEANINGS.items() for x in (F.lit(k), F.array(*[F.lit(b) for b in v]))])
    grow = lambda acc, c: F.flatten(F.transform(acc, lambda a: F.transform(F.coalesce(F.try_element_at(means, c), F.array(c)), lambda b: F.concat(a, b))))
    return F.aggregate(symbols(F.upper(_col(primer))), F.array(F.lit("")), grow)


def all_kmers(spark: SparkSession, k: int, alphabet: str = RNA) -> DataFrame:
    """(kmer): every word of length k over an alphabet, which is unrolled k times."""
    letters = F.array(*[F.lit(c) for c in alphabet])
    out = spark.range(1).select(F.lit("").alias("kmer"))
    for _ in range(k):
        out = out.withColumn("c", F.explode(letters)).select(F.concat("kmer", "c").alias("kmer"))
    return out


def accession_of_protein(protein_id) -> Column:
    """Genome accession in a protein id: its first 15 characters, the last underscore as a dot."""
    return F.regexp_replace(F.substring(_col(protein_id), 1, 15), "_(?=[^_]*$)", ".")


def hex_colour(r, g, b, a=None) -> Column:
    """#RRGGBB[AA] of channels between 0 and 1."""
    byte = lambda x: F.least(F.lit(255), F.greatest(F.lit(0), F.round(_col(x) * 255).cast("int")))
    parts = [byte(x) for x in (r, g, b)] + ([byte(a)] if a is not None else [])
    return F.format_string("#" + "%02X" * len(parts), *parts)


def rgb_text_to_hex(rgb) -> Column:
    """'rgb(100,200,255)' as #64C8FF."""
    n = F.transform(F.regexp_extract_all(_col(rgb), F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("int"))
    return F.format_string("#%02X%02X%02X", F.get(n, 0), F.get(n, 1), F.get(n, 2))


def rgb_text_to_unit(rgb) -> Column:
    """'rgb(100,200,255)' as three doubles between 0 and 1."""
    return F.transform(F.regexp_extract_all(_col(rgb), F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("double") / 255)
