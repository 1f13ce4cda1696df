"""Codon counts, frequencies by sequence and by amino acid, and codon usage bias."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake import alphabet as ab
from strandlake.functions import kmers as fn
from strandlake.operators import kernels


def coding(seqs: DataFrame, ignore_invalid: bool = True, include_noncanonical: bool = False) -> DataFrame:
    """Sequences that are coding ones; invalid ones are left out, or an error if not ``ignore_invalid``."""
    if ignore_invalid:
        return _coding_only(seqs, include_noncanonical)
    fit = fn.is_cds(F.col("seq"), include_noncanonical)
    return seqs.withColumn("seq", F.when(fit, F.col("seq")).otherwise(F.raise_error(F.concat(F.lit("not a coding sequence: "), F.col("seq_id").cast("string")))))


def _coding_only(seqs: DataFrame, include_noncanonical: bool) -> DataFrame:
    """Rows that ``is_cds`` is true of. A filter would be pushed below what makes the sequences, and make them anew for each mention."""
    at = seqs.columns.index("seq")

    def run(batches):
        for b in batches:
            seq = b.column(at)
            length = pc.utf8_length(seq)
            fit = pc.and_(pc.equal(pc.multiply(pc.divide(length, 3), 3), length), pc.greater_equal(length, 3))
            if not include_noncanonical:
                for start, stop, codons in ((0, 3, ab.STARTS), (-3, None, ab.STOPS)):
                    fit = pc.and_(fit, pc.is_in(pc.utf8_slice_codeunits(seq, start, stop), value_set=pa.array(codons, seq.type)))
            yield b.filter(fit)

    return kernels.map_arrow(seqs, run, seqs.schema)


def counts(seqs: DataFrame, include_start: bool = True, include_stop: bool = True) -> DataFrame:
    """Rows (sample, seq_id, codon, codon_id, aa, count). Codons with other letters than ACGT are left out.

    Ids are of the forward strand. Without ``include_start`` the first codon is
    not counted, without ``include_stop`` the last. A sequence is counted where
    it is read; only its at most 64 sums are shuffled.
    """
    keep = kernels.identity(seqs)

    def kernel(seqs):
        total = np.zeros(64 * len(seqs), np.int64)
        last = np.array([3 * (len(s or b"") // 3 - (0 if include_stop else 1)) for s in seqs], np.int64)
        for block in kernels.laid(seqs, 3):
            at, ids = kernels.positions_and_ids(kernels.codes(block.data), 3, False)
            rows, pos = block.place(at)
            own = (pos % 3 == 0) & (pos >= (0 if include_start else 3)) & (pos < last[rows])
            total += np.bincount(64 * rows[own] + ids[own], minlength=len(total))
        found = np.flatnonzero(total)
        yield found // 64, [(found % 64).astype(np.int32), total[found]]

    counted = kernels.per_batch(seqs, keep, "codon_id int, n long", kernel).groupBy(*keep, "codon_id").agg(F.sum("n").alias("count"))
    codon = F.array(*map(F.lit, ab.CODONS))[F.col("codon_id")]
    return counted.withColumn("codon", codon).select(*keep, "codon", "codon_id", fn.amino(F.col("codon")).alias("aa"), "count")


def frequencies(rows: DataFrame) -> DataFrame:
    """Adds freq_len (share of the sequence's codons) and freq_family (share of the amino acid's).

    Both sums are over a sequence's at most 64 rows, on one partitioning.
    """
    keep = kernels.identity(rows)
    whole, family = Window.partitionBy(*keep), Window.partitionBy(*keep, "aa")
    summed = rows.withColumn("t", F.sum("count").over(whole)).withColumn("f", F.sum("count").over(family))
    return summed.withColumn("freq_len", F.col("count") / F.col("t")).withColumn("freq_family", F.col("count") / F.col("f")).drop("f", "t")


def table(rows: DataFrame, value: str = "count", stops: bool = True) -> DataFrame:
    """One row a sequence, one column a codon (64, or 61 without stops), zeros where none."""
    names = [c for c in ab.CODONS if stops or ab.CODON_AMINO[c] != "*"]
    return rows.groupBy(*sorted(kernels.identity(rows), reverse=True)).pivot("codon", names).agg(F.sum(value)).na.fill(0)


def expected(reference: DataFrame, length: int) -> DataFrame:
    """Rows (codon_id, expected, share): whole codons expected in ``length`` bases by the reference's counts."""
    sums = reference.groupBy("codon_id").agg(F.sum("count").alias("n"))
    total = sums.agg(F.sum("n").alias("t"))
    rows = sums.crossJoin(F.broadcast(total)).select("codon_id", F.floor(F.col("n") / F.col("t") * (length / 3)).alias("expected"))
    kept = rows.agg(F.sum("expected").alias("k"))
    return rows.crossJoin(F.broadcast(kept)).select("codon_id", "expected", F.try_divide("expected", "k").alias("share"))


def usage_bias(reference: DataFrame, tested: DataFrame, ddof: int = 0) -> DataFrame:
    """Rows (seq_id, sample, chisq, dof, pvalue, bonferroni) of sequences without a zero expectation.

    ``reference`` and ``tested`` are rows of ``counts``; see ``chi_square``. dof
    is sense codons - 1 - ddof; bonferroni multiplies by the number of tests.
    """
    stat = chi_square(reference, tested)
    dof = len(ab.SENSE) - 1 - ddof

    @F.pandas_udf("double")
    def tail(chisq: pd.Series) -> pd.Series:
        return chisq.map(lambda x: chi_square_tail(x, dof))

    tests = stat.agg(F.count("*").alias("tests"))
    joined = stat.withColumn("dof", F.lit(dof)).withColumn("pvalue", tail("chisq")).crossJoin(F.broadcast(tests))
    return joined.withColumn("bonferroni", F.least(F.lit(1.0), F.col("pvalue") * F.col("tests"))).drop("tests")


def chi_square(reference: DataFrame, tested: DataFrame) -> DataFrame:
    """Rows (seq_id, sample, chisq): sum over sense codons of (o - e)^2 / e, o and e as shares.

    A codon's expectation in a sequence is floor(reference share x its codons),
    made a share again. Sequences with a zero expectation are left out.
    """
    sense = len(ab.SENSE)
    sums = reference.where("aa <> '*'").groupBy("codon_id").agg(F.sum("count").alias("n"))
    total = sums.agg(F.sum("n").alias("t"))
    share = sums.crossJoin(F.broadcast(total)).select("codon_id", (F.col("n") / F.col("t")).alias("share"))
    keep = sorted(kernels.identity(tested), reverse=True)
    sizes = tested.groupBy(*keep).agg(F.sum("count").alias("size"), F.sum(F.when(F.col("aa") != "*", F.col("count")).otherwise(0)).alias("sense"))
    want = sizes.where("sense > 0").crossJoin(F.broadcast(share)).select(*keep, "sense", "codon_id", F.floor(F.col("share") * F.col("size")).alias("e"))
    got = tested.where("aa <> '*'").select(*keep, "codon_id", "count")
    met = want.join(got, [*keep, "codon_id"], "left").na.fill(0, ["count"])
    # sum (o - e)^2 / e = sum o^2 / e - 2 sum o + sum e; both shares sum to one
    per = met.groupBy(*keep).agg(
        F.sum(F.try_divide(F.pow(F.col("count") / F.col("sense"), F.lit(2.0)), F.col("e"))).alias("q"), F.sum("e").alias("whole"), F.count(F.when(F.col("e") > 0, 1)).alias("some")
    )
    return per.where(F.col("some") == sense).select(*keep, (F.col("q") * F.col("whole") - 1).alias("chisq"))


def chi_square_tail(x: float, dof: int) -> float:
    """P(chi-square with ``dof`` > x), by the regularised incomplete gamma function."""
    if dof <= 0 or x is None or math.isnan(x):
        return float("nan")
    a, y = dof / 2, x / 2
    if y <= 0:
        return 1.0
    scale = math.exp(-y + a * math.log(y) - math.lgamma(a))
    if y < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= y / n
            total += term
        return 1 - total * scale
    b, c, d = y + 1 - a, 1e300, 1 / (y + 1 - a)
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / ((an * d + b) or 1e-300)
        c = (b + an / c) or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * h
