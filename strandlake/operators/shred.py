"""Sequences to k-mer occurrences and profiles.

Sequences are rows (sample, seq_id, seq). Kernels cut windows and count them before
the shuffle, as ids or, where ambiguity codes are expanded, as words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake import alphabet as ab
from strandlake.functions import kmers as fn
from strandlake.operators import kernels

#: Up to this k a task counts in dense vectors, of so many cells together; above it a batch is counted by sorting.
DENSE_K = 10
DENSE_CELLS = 1 << 23
#: Up to so many possible words a task counts words in dense vectors.
DENSE_WORDS = 1 << 16


def windows(seqs: DataFrame, k: int, keep: tuple[str, ...] = ("sample", "seq_id")) -> DataFrame:
    """Rows (*keep, pos, kmer): every window of ``k`` letters, positions from 0. Shorter sequences give none."""

    def kernel(seqs):
        for block in kernels.laid([s if s is not None and s.isascii() else None for s in seqs], k):
            at = block.whole(k)
            rows, pos = block.place(at)
            yield rows, [pos.astype(np.int32), kernels.words(block.data, at, k)]
        for r, seq in enumerate(seqs):
            # Letters of more than one byte: positions count letters.
            if seq is None or seq.isascii():
                continue
            seq = seq.decode()
            for at in range(0, len(seq) - k + 1, kernels.BLOCK):
                pos = np.arange(at, min(at + kernels.BLOCK, len(seq) - k + 1), dtype=np.int32)
                yield np.full(len(pos), r), [pos, pa.array([seq[i : i + k] for i in pos.tolist()], pa.string())]

    return kernels.per_batch(seqs, list(keep), "pos int, kmer string", kernel)


def occurrences(seqs: DataFrame, k: int, ambiguous: str = "expand", fold: bool = True, strict: bool = False) -> DataFrame:
    """Rows (sample, seq_id, pos, kmer, kmer_id).

    ambiguous 'expand': a k-mer with IUPAC codes gives each k-mer it stands for,
    at its position; 'drop': it gives none. With ``strict`` a sequence shorter
    than k or with other letters is an error; else short ones give none and
    k-mers with other letters are left out.
    """
    if ambiguous not in ("expand", "drop"):
        raise ValueError("ambiguous is 'expand' or 'drop'")
    if strict:
        wrong = (F.length("seq") < k) | ~fn.is_nucleotide(F.col("seq"))
        seqs = seqs.withColumn("seq", F.when(wrong, F.raise_error(F.concat(F.lit("unfit sequence "), F.col("seq_id").cast("string")))).otherwise(F.col("seq")))
    if ambiguous == "drop":
        return _known(seqs, k, fold)
    rows = windows(seqs, k)
    own = F.when(F.col("kmer").rlike("^[ACGT]+$"), F.array("kmer")).otherwise(fn.expand(F.col("kmer")))
    rows = rows.withColumn("kmer", F.explode(own))
    return rows.withColumn("kmer_id", (fn.canonical if fold else fn.encode)(F.col("kmer")))


def _known(seqs: DataFrame, k: int, fold: bool) -> DataFrame:
    """Rows (sample, seq_id, pos, kmer, kmer_id) of the k-mers of ACGT only; positions count letters."""

    def kernel(seqs):
        # A letter of several bytes is put down as one unknown byte, so that places are positions.
        seqs = [s if s is None or s.isascii() else s.decode().encode("ascii", "replace") for s in seqs]
        for block in kernels.laid(seqs, k):
            at, ids = kernels.positions_and_ids(kernels.codes(block.data), k, fold)
            rows, pos = block.place(at)
            yield rows, [pos.astype(np.int32), kernels.words(block.data, at, k), ids]

    return kernels.per_batch(seqs, ["sample", "seq_id"], "pos int, kmer string, kmer_id long", kernel)


def word_counts(seqs: DataFrame, k: int, letters: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows (*by, kmer, n): how often each window of ``k`` of the ASCII ``letters`` is there.

    Few possible words are counted in dense vectors that last for the task, others block by block.
    """
    table = np.full(256, 255, np.uint8)
    table[np.frombuffer(letters.encode(), np.uint8)] = np.arange(len(letters))
    size, cells = len(letters), len(letters) ** k

    def word(i: int) -> str:
        return "".join(letters[i // size**j % size] for j in reversed(range(k)))

    def run(batches):
        dense: dict[tuple, np.ndarray] = {}
        types = [None] * len(by)

        def rows(key, found, counts):
            return pa.RecordBatch.from_arrays([*(pa.array([v] * len(found), t) for v, t in zip(key, types)), found, pa.array(counts, pa.int64())], [*by, "kmer", "n"])

        def emptied():
            for key, total in dense.items():
                found = np.flatnonzero(total)
                yield rows(key, pa.array([word(int(i)) for i in found], pa.string()), total[found])
            dense.clear()

        for b in batches:
            types = [b.schema.field(i).type for i in range(len(by))]
            for key, own in _grouped(b, len(by)):
                for block in kernels.laid(own, k):
                    codes = table[block.data]
                    n = len(codes) - k + 1
                    ids, bad = np.zeros(n, np.int64), np.zeros(n, bool)
                    for j in range(k):
                        bad |= codes[j : j + n] == 255
                        if cells <= DENSE_WORDS:
                            ids = ids * size + codes[j : j + n]
                    if cells > DENSE_WORDS:
                        met = pc.value_counts(kernels.words(block.data, np.flatnonzero(~bad), k))
                        yield rows(key, met.field("values"), met.field("counts"))
                        continue
                    if key not in dense:
                        if (len(dense) + 1) * cells > DENSE_CELLS:
                            yield from emptied()
                        dense[key] = np.zeros(cells, np.int64)
                    dense[key] += np.bincount(ids[~bad], minlength=cells)
        yield from emptied()

    kinds = dict(seqs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "kmer string, n long"])
    return kernels.map_arrow(seqs.select(*by, "seq"), run, schema).groupBy(*by, "kmer").agg(F.sum("n").alias("n"))


def profile(seqs: DataFrame, k: int, ambiguous: str = "expand", fold: bool = True, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows (*by, kmer_id, count): words are counted first, so only distinct ones are expanded and encoded."""
    if ambiguous == "drop":
        return profile_fast(seqs, k, fold, by)
    counted = word_counts(seqs, k, "".join(ab.IUPAC), by)
    plain = F.col("kmer").rlike("^[ACGT]+$")
    counted = counted.withColumn("kmer", F.explode(F.when(plain, F.array("kmer")).otherwise(fn.expand(F.col("kmer")))))
    coded = counted.withColumn("kmer_id", (fn.canonical if fold else fn.encode)(F.col("kmer")))
    return coded.groupBy(*by, "kmer_id").agg(F.sum("n").alias("count"))


def _grouped(batch: pa.RecordBatch, width: int) -> list[tuple[tuple, list[bytes]]]:
    """The sequences in the column after ``width`` key columns, by key."""
    groups: dict[tuple, list[bytes]] = {}
    seqs = batch.column(width).cast(pa.binary()).to_pylist()
    keys = list(zip(*(batch.column(i).to_pylist() for i in range(width)))) if width else [()] * len(seqs)
    for key, s in zip(keys, seqs):
        if s is not None:
            groups.setdefault(key, []).append(s)
    return list(groups.items())


def _counted(seqs: DataFrame, ks: list[int], fold: bool, by: tuple[str, ...]) -> DataFrame:
    """Partial rows (*by, k, kmer_id, n) of every k, from one pass over the sequences.

    Sequences of a batch are laid end to end in blocks, with breaks between, so a
    window never crosses them. Small k are counted in dense vectors that last for the
    task, so a task gives each id of a group about once.
    """

    def run(batches):
        dense: dict[tuple, np.ndarray] = {}
        held, types = 0, [None] * len(by)

        def rows(key, k, found, counts):
            cols = [pa.array([v] * len(found), t) for v, t in zip(key, types)]
            return pa.RecordBatch.from_arrays([*cols, pa.array(np.full(len(found), k, np.int32)), pa.array(found, pa.int64()), pa.array(counts, pa.int64())], [*by, "k", "kmer_id", "n"])

        def emptied():
            for (key, k), total in dense.items():
                found = np.flatnonzero(total)
                yield rows(key, k, found, total[found])
            dense.clear()

        for b in batches:
            types = [b.schema.field(i).type for i in range(len(by))]
            for key, own in _grouped(b, len(by)):
                for k, block in ((k, block) for k in ks for block in kernels.laid(own, k)):
                    ids = kernels.positions_and_ids(kernels.codes(block.data), k, fold)[1]
                    if k > DENSE_K:
                        yield rows(key, k, *np.unique(ids, return_counts=True))
                        continue
                    if (key, k) not in dense:
                        if held + 4**k > DENSE_CELLS:
                            yield from emptied()
                            held = 0
                        dense[key, k] = np.zeros(4**k, np.int64)
                        held += 4**k
                    if 4**k > kernels.BLOCK:
                        np.add.at(dense[key, k], ids, 1)
                    else:
                        dense[key, k] += np.bincount(ids, minlength=4**k)
        yield from emptied()

    kinds = dict(seqs.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in by), "k int, kmer_id long, n long"])
    return kernels.map_arrow(seqs.select(*by, "seq"), run, schema)


def profile_fast(seqs: DataFrame, k: int, fold: bool = True, by: tuple[str, ...] = ()) -> DataFrame:
    """The same rows as ``profile(ambiguous='drop')``, counted in numpy before Spark's final sum; groups named in ``by`` are counted apart."""
    return _counted(seqs, [k], fold, by).groupBy(*by, "kmer_id").agg(F.sum("n").alias("count"))


def multi_k(seqs: DataFrame, ks: list[int], fold: bool = True) -> DataFrame:
    """Rows (k, kmer_id, count) of every k, from one pass over the sequences."""
    return _counted(seqs, ks, fold, ()).groupBy("k", "kmer_id").agg(F.sum("n").alias("count"))


def amino_profile(seqs: DataFrame, k: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows (*by, kmer_id, count) of amino-acid k-mers by their five-bit ids; those with other letters are left out, strands don't exist."""
    if not 1 <= k <= fn.MAX_AMINO_K:
        raise ValueError(f"k must be 1..{fn.MAX_AMINO_K}")
    counted = kernels.per_sequence(seqs, list(by), "kmer_id long, n long", lambda seq: kernels.amino_counts(seq, k))
    return counted.groupBy(*by, "kmer_id").agg(F.sum("n").alias("count"))


def chunk(seqs: DataFrame, k: int, size: int = 1_000_000) -> DataFrame:
    """Long sequences cut into pieces of ``size`` that overlap by k - 1, so every window stays in one piece."""
    step = max(1, size - k + 1)
    last = F.greatest(F.lit(0), F.length("seq") - k)
    starts = F.sequence(F.lit(0), last, F.lit(step))
    return seqs.select(*[c for c in seqs.columns if c != "seq"], F.col("seq").alias("__s"), F.explode(starts).alias("offset")).withColumn("seq", F.col("__s").substr(F.col("offset") + 1, F.lit(size))).drop("__s")
