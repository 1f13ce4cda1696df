"""Column functions on sequences and k-mers. All stay inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandlake import alphabet as ab

MAX_K = 31
MAX_AMINO_K = 12


def _check(k: int) -> None:
    if not 1 <= k <= MAX_K:
        raise ValueError(f"k must be 1..{MAX_K}")


def clean(text: Column, alphabet: str = "ACGT") -> Column:
    """Letters of ``alphabet`` only, upper-cased. Filtering comes first: upper-casing may make letters."""
    return F.upper(F.regexp_replace(text, f"[^{alphabet}{alphabet.lower()}]+", ""))


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, ab.COMPLEMENT_FROM, ab.COMPLEMENT_TO))


def encode(kmer: Column) -> Column:
    """Two-bit id of a k-mer, first base highest; null if it holds anything but ACGT."""
    return F.when(kmer.rlike("^[ACGT]+$"), F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("bigint"))


def encode_amino(kmer: Column) -> Column:
    """Five-bit id of an amino-acid k-mer by residue order; null with any other letter. Never strand-folded."""
    at = lambda c: F.instr(F.lit(ab.AMINO_ACIDS), c) - 1
    total = F.aggregate(F.split(kmer, ""), F.lit(0).cast("bigint"), lambda a, c: F.shiftleft(a, 5).bitwiseOR(at(c).cast("bigint")))
    return F.when(kmer.rlike(f"^[{ab.AMINO_ACIDS}]+$"), total)


def canonical(kmer: Column) -> Column:
    """The smaller of the ids of a k-mer and its reverse complement; null with ambiguity."""
    return F.least(encode(kmer), encode(reverse_complement(kmer)))


def canonical_id(kmer_id: Column, k: int) -> Column:
    """The smaller of a forward id and the id of its reverse complement, by arithmetic on two-bit letters."""
    _check(k)
    back = F.lit(0).cast("bigint")
    for j in range(k):
        back = back + F.shiftleft(3 - F.shiftrightunsigned(kmer_id, 2 * j).bitwiseAND(F.lit(3)), 2 * (k - 1 - j)).cast("bigint")
    return F.least(kmer_id, back)


def decode(kmer_id: Column, k: int) -> Column:
    _check(k)
    return F.translate(F.lpad(F.conv(kmer_id.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def left_neighbours(kmer: Column, fold: bool = True) -> Column:
    """Ids of the four k-mers that end in this one's first k - 1 bases."""
    make = canonical if fold else encode
    return F.array(*[make(F.concat(F.lit(c), kmer.substr(F.lit(1), F.length(kmer) - 1))) for c in ab.BASES])


def right_neighbours(kmer: Column, fold: bool = True) -> Column:
    """Ids of the four k-mers that start with this one's last k - 1 bases."""
    make = canonical if fold else encode
    return F.array(*[make(F.concat(kmer.substr(F.lit(2), F.length(kmer)), F.lit(c))) for c in ab.BASES])


def neighbours(kmer: Column, fold: bool = True) -> Column:
    return F.concat(left_neighbours(kmer, fold), right_neighbours(kmer, fold))


def is_right_neighbour(a: Column, b: Column) -> Column:
    """The last k - 1 bases of ``a`` are the first k - 1 of ``b``, on either strand of ``b``."""
    tail, r = a.substr(F.lit(2), F.length(a)), reverse_complement(b)
    return (tail == b.substr(F.lit(1), F.length(b) - 1)) | (tail == r.substr(F.lit(1), F.length(b) - 1))


def is_left_neighbour(a: Column, b: Column) -> Column:
    """The first k - 1 bases of ``a`` are the last k - 1 of ``b``, on either strand of ``b``."""
    head, r = a.substr(F.lit(1), F.length(a) - 1), reverse_complement(b)
    return (head == b.substr(F.lit(2), F.length(b))) | (head == r.substr(F.lit(2), F.length(b)))


def are_neighbours(a: Column, b: Column) -> Column:
    return is_right_neighbour(a, b) | is_left_neighbour(a, b)


def expand(kmer: Column, codes: dict[str, str] | None = None) -> Column:
    """Every unambiguous k-mer that the codes of ``kmer`` stand for, in order; none with other letters."""
    codes = codes or ab.IUPAC
    table = F.create_map(*[x for c, v in codes.items() for x in (F.lit(c), F.array(*map(F.lit, v)))])
    known = kmer.rlike(f"^[{''.join(codes)}]+$")
    grown = F.aggregate(
        F.split(kmer, ""), F.array(F.lit("")),
        lambda acc, c: F.flatten(F.transform(acc, lambda p: F.transform(table[c], lambda x: F.concat(p, x)))),
    )
    return F.when(known, grown).otherwise(F.array().cast("array<string>"))


def is_nucleotide(seq: Column) -> Column:
    return seq.rlike(f"^[{''.join(ab.IUPAC)}]*$")


def is_amino(seq: Column) -> Column:
    """Amino-acid letters, and not a nucleotide sequence."""
    letters = ab.AMINO_ACIDS + "".join(ab.AMINO_AMBIGUOUS) + "X"
    return ~is_nucleotide(seq) & seq.rlike(f"^[{letters}]*$")


def letters(seq: Column) -> Column:
    """Distinct letters, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.split(seq, ""), lambda c: c != "")))


def extended_symbols(seq: Column) -> Column:
    return F.array_intersect(letters(seq), F.array(*map(F.lit, ab.EXTENDED + "N")))


def foreign_symbols(seq: Column) -> Column:
    return F.array_except(letters(seq), F.array(*map(F.lit, "".join(ab.IUPAC))))


def is_cds(seq: Column, include_noncanonical: bool = False) -> Column:
    """Length divisible by three and, unless others are included, a start codon first and a stop codon last."""
    whole = (F.length(seq) % 3 == 0) & (F.length(seq) >= 3)
    if include_noncanonical:
        return whole
    return whole & F.substring(seq, 1, 3).isin(*ab.STARTS) & F.substring(seq, -3, 3).isin(*ab.STOPS)


def codons(seq: Column) -> Column:
    """Non-overlapping triplets in order; a short tail is left out."""
    n = F.floor(F.length(seq) / 3).cast("int")
    made = F.transform(F.sequence(F.lit(0), n - 1), lambda i: seq.substr(i * 3 + 1, F.lit(3)))
    return F.when(n >= 1, made).otherwise(F.array().cast("array<string>"))


def amino(codon: Column) -> Column:
    """One-letter residue of a codon, '*' for stops, null for ambiguity."""
    return F.create_map(*[F.lit(x) for pair in ab.CODON_AMINO.items() for x in pair])[codon]


def sample_name(path: Column) -> Column:
    """File name up to its first dot."""
    return F.regexp_extract(path, r"([^/.]+)[^/]*$", 1)


def is_float(text: Column) -> Column:
    return text.try_cast("double").isNotNull()


def is_integer(text: Column) -> Column:
    return text.rlike(r"^[+-]?[0-9]+$")
