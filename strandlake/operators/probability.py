"""Markov log-odds of sequences under a profile's transition probabilities."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.operators import kernels, shred
from strandlake.operators.shred import DENSE_K


def markov_log_odds(seqs: DataFrame, profile: DataFrame, bases: DataFrame, k: int) -> DataFrame:
    """Rows (sample, seq_id, log_p, log_null, log_odds), natural logarithms.

    log_p: the first k-mer's frequency times, for each next k-mer, its count
    over the counts of the four k-mers with the same first k - 1 bases.
    log_null: the product of single base frequencies. ``profile`` is a forward
    profile of k, ``bases`` one of k = 1. K-mers that the profile lacks add nothing.
    """
    keep = kernels.identity(seqs)
    if k <= DENSE_K:
        return _by_table(seqs, keep, profile, bases, k)
    total = profile.agg(F.sum("count").alias("t"))
    stem = profile.withColumn("stem", F.floor(F.col("kmer_id") / 4))
    per_stem = stem.groupBy("stem").agg(F.sum("count").alias("s"))
    steps = stem.join(per_stem, "stem").crossJoin(F.broadcast(total)).select("kmer_id", F.ln(F.col("count") / F.col("s")).alias("step"), F.ln(F.col("count") / F.col("t")).alias("start"))
    all_bases = bases.agg(F.sum("count").alias("t"))
    null = bases.crossJoin(F.broadcast(all_bases)).select("kmer_id", F.ln(F.col("count") / F.col("t")).alias("b"))
    rows = shred.occurrences(seqs, k, "drop", fold=False).join(steps, "kmer_id")
    p = rows.groupBy(*keep).agg(F.sum(F.when(F.col("pos") == 0, F.col("start")).otherwise(F.col("step"))).alias("log_p"))
    singles = shred.profile(seqs, 1, "drop", False, tuple(keep)).join(F.broadcast(null), "kmer_id")
    q = singles.groupBy(*keep).agg(F.sum(F.col("count") * F.col("b")).alias("log_null"))
    return p.join(q, keep).withColumn("log_odds", F.col("log_p") - F.col("log_null"))


def _by_table(seqs: DataFrame, keep: list[str], profile: DataFrame, bases: DataFrame, k: int) -> DataFrame:
    """The same by dense tables of at most 4^DENSE_K entries, which every task gets: sequences aren't exploded or shuffled."""
    count, single = np.zeros(4**k), np.zeros(4)
    for table, rows in ((count, profile), (single, bases)):
        for i, n in rows.select("kmer_id", "count").collect():
            table[i] = n
    with np.errstate(divide="ignore", invalid="ignore"):
        step, start, base = np.log(count / np.repeat(count.reshape(-1, 4).sum(axis=1), 4)), np.log(count / count.sum()), np.log(single / single.sum())
    step[count == 0] = start[count == 0] = np.nan
    base[single == 0] = np.nan
    tables = seqs.sparkSession.sparkContext.broadcast((step, start, base))

    def summed(worth, rows, n):
        known = ~np.isnan(worth)
        return np.bincount(rows[known], worth[known], n), np.bincount(rows[known], minlength=n)

    def kernel(seqs):
        step, start, base = tables.value
        n = len(seqs)
        p, q, met, seen = np.zeros(n), np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for block in kernels.laid(seqs, k):
            at, ids = kernels.positions_and_ids(kernels.codes(block.data), k, False)
            rows, pos = block.place(at)
            more, times = summed(np.where(pos == 0, start[ids], step[ids]), rows, n)
            p, met = p + more, met + times
        for block in kernels.laid(seqs, 1):
            data = kernels.codes(block.data)
            at = np.flatnonzero(data < 4)
            more, times = summed(base[data[at]], block.place(at)[0], n)
            q, seen = q + more, seen + times
        found = np.flatnonzero((met > 0) & (seen > 0))
        yield found, [p[found], q[found], (p - q)[found]]

    return kernels.per_batch(seqs, keep, "log_p double, log_null double, log_odds double", kernel)
