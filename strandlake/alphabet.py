"""Nucleotide alphabets, ambiguity codes and the genetic code."""

from __future__ import annotations

# The IUPAC nucleotide codes and their complements.
BASES = "ACGT"
IUPAC = {
    "A": "A", "C": "C", "G": "G", "T": "T",
    "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC",
    "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT",
}
COMPLEMENT_FROM = "ACGTRYSWKMBDHVN"
COMPLEMENT_TO = "TGCAYRSWMKVHDBN"
EXTENDED = "RYSWKMBDHV"

# Amino-acid letters (20 residues, unknown, and the ambiguity letters).
AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY"
AMINO_AMBIGUOUS = {"B": "DN", "Z": "EQ", "J": "IL"}

# The standard genetic code, codons in ACGT order, '*' for stop.
GENETIC_CODE = "KNKNTTTTRSRSIIMIQHQHPPPPRRRRLLLLEDEDAAAAGGGGVVVV*Y*YSSSS*CWCLFLF"
STARTS = ("ATG", "GTG", "TTG")
STOPS = ("TAA", "TAG", "TGA")


def codon(i: int) -> str:
    """The codon with forward id ``i``."""
    return BASES[i >> 4] + BASES[i >> 2 & 3] + BASES[i & 3]


CODONS = [codon(i) for i in range(64)]
CODON_AMINO = dict(zip(CODONS, GENETIC_CODE))
SENSE = [i for i in range(64) if GENETIC_CODE[i] != "*"]
