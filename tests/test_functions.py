from itertools import product

import pytest
from pyspark.sql import functions as F
from strandlake import alphabet as ab
from strandlake.functions import kmers as fn


def column(spark, values, make, name="s"):
    rows = [(i, v) for i, v in enumerate(values)]
    return [r.x for r in spark.createDataFrame(rows, f"i int, {name} string").select("i", make(F.col(name)).alias("x")).orderBy("i").collect()]


def code(s):
    return sum("ACGT".index(c) * 4 ** (len(s) - 1 - i) for i, c in enumerate(s))


def rc(s):
    return s[::-1].translate(str.maketrans(ab.COMPLEMENT_FROM, ab.COMPLEMENT_TO))


def test_dimers_have_the_ids_0_to_15(spark):
    dimers = ["".join(p) for p in product("ACGT", repeat=2)]
    assert column(spark, dimers, fn.encode) == list(range(16))
    assert column(spark, dimers, fn.canonical) == [min(code(d), code(rc(d))) for d in dimers]


def test_ambiguous_and_empty_kmers_have_no_id(spark):
    assert column(spark, ["ATCNATC", "", None, "acgt", "ACGU"], fn.encode) == [None] * 5


def test_ids_are_exact_up_to_the_largest_k(spark):
    assert column(spark, ["T" * 31, "A" * 31, "C" + "A" * 30], fn.encode) == [4**31 - 1, 0, 4**30]
    assert [r.x for r in spark.range(1).select(fn.decode(F.lit(4**31 - 1), 31).alias("x")).collect()] == ["T" * 31]
    with pytest.raises(ValueError):
        fn.decode(F.lit(1), 32)


def test_reverse_complement_twice_is_the_sequence(spark):
    seqs = ["ACGT", "AAAA", ab.COMPLEMENT_FROM, "", "GATTACA"]
    assert column(spark, seqs, lambda c: fn.reverse_complement(fn.reverse_complement(c))) == seqs
    assert column(spark, ["ACGT", "AAC", "RYN"], fn.reverse_complement) == ["ACGT", "GTT", "NRY"]


def test_expansion_counts(spark):
    got = column(spark, ["RNA", "BRY", "NNN", "ACG", "AXG"], fn.expand)
    assert [len(x) for x in got] == [8, 12, 64, 1, 0]
    assert got[1] == ["".join(p) for p in product("CGT", "AG", "CT")]


def test_neighbours(spark):
    left, right, both = (column(spark, ["ACG"], lambda c, f=f: f(c, False))[0] for f in (fn.left_neighbours, fn.right_neighbours, fn.neighbours))
    assert left == [code(c + "AC") for c in "ACGT"] and right == [code("CG" + c) for c in "ACGT"] and both == left + right
    assert column(spark, ["ACG"], fn.right_neighbours)[0] == [min(code("CG" + c), code(rc("CG" + c))) for c in "ACGT"]
    rows = spark.createDataFrame([("ACGT", "CGTA"), ("ACGT", "TACG"), ("ACGT", rc("CGTA")), ("ACGT", "TTTT")], "a string, b string")
    assert [r.x for r in rows.select(fn.are_neighbours(F.col("a"), F.col("b")).alias("x")).collect()] == [True, True, True, False]


def test_alphabet_predicates(spark):
    seqs = ["ACGTN", "acgt", "MKVL", "A1", "", "RYSW"]
    assert column(spark, seqs, fn.is_nucleotide) == [True, False, False, False, True, True]
    assert column(spark, seqs, fn.is_amino) == [False, False, True, False, False, False]
    assert column(spark, ["GATTN1"], fn.foreign_symbols) == [["1"]] and column(spark, ["GATTRN"], fn.extended_symbols) == [["N", "R"]]


def test_amino_ids_are_never_folded(spark):
    assert column(spark, ["AC", "YY", "AZ"], fn.encode_amino) == [1, 19 * 32 + 19, None]


@pytest.mark.parametrize(("seq", "plain", "other"), [("ATGAAATAA", True, True), ("GTGTAG", True, True), ("TTGTGA", True, True), ("ATGAAAAAA", False, True), ("AAATAA", False, True), ("ATGTA", False, False), ("", False, False)])
def test_coding_sequences(spark, seq, plain, other):
    assert column(spark, [seq], fn.is_cds) == [plain] and column(spark, [seq], lambda c: fn.is_cds(c, True)) == [other]


def test_the_genetic_code(spark):
    assert column(spark, ["ATG", "TGG", "TAA", "TAG", "TGA", "AGC", "CGA", "ANA"], fn.amino) == ["M", "W", "*", "*", "*", "S", "R", None]
    assert [ab.CODONS[i] for i in (48, 50, 56)] == ["TAA", "TAG", "TGA"] and len(ab.SENSE) == 61
    assert column(spark, ["ATGAAATAAC", "AC", ""], fn.codons) == [["ATG", "AAA", "TAA"], [], []]


def test_names_and_numbers(spark):
    assert column(spark, ["/a/b.c/x1.fa.gz", "y.fa", "z"], fn.sample_name) == ["x1", "y", "z"]
    assert column(spark, ["1", "-2", "1.5", "x", "1e3", ""], fn.is_float) == [True, True, True, False, True, False]
    assert column(spark, ["1", "-2", "1.5", "x"], fn.is_integer) == [True, True, False, False]
