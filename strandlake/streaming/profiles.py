"""K-mer counts of sequences that keep arriving, with the batch operators' own expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame

from strandlake.operators import shred


def running_profile(seqs: DataFrame, k: int, fold: bool = True) -> DataFrame:
    """A streaming profile (kmer_id, count), for output modes 'update' or 'complete'; state is one count a k-mer."""
    rows = shred.occurrences(seqs, k, "drop", fold)
    return rows.groupBy("kmer_id").count()
