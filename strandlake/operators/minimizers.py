"""Minimizers by stride and by window, and seeds that sequences share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.operators import kernels

#: Seeds of a reference that every task may get, and pairs of seeds that are counted at once.
SEED_ROWS = 2_000_000
MEETINGS = 1 << 20

def stride_minimizers(seqs: DataFrame, k: int, w: int, fold: bool = True) -> DataFrame:
    """Rows (sample, seq_id, pos, kmer_id, is_min): every ``w``-th position is marked."""

    def kernel(seq):
        for at, data in kernels.blocks(seq, k):
            pos, ids = kernels.positions_and_ids(data, k, fold)
            yield [(pos + at).astype("int32"), ids, ((pos + at) % w == 0).astype("int32")]

    return kernels.per_sequence(seqs, kernels.identity(seqs), "pos int, kmer_id long, is_min int", kernel)


def window_minimizers(seqs: DataFrame, k: int, w: int, fold: bool = True) -> DataFrame:
    """Rows (sample, seq_id, pos, kmer_id, is_min): marked where a k-mer is the least of some ``w`` consecutive ones.

    Of equal ids in a window the first counts. A sequence with fewer than ``w``
    k-mers is one window. Windows never leave a row of ``seqs``, so nothing is shuffled.
    """

    def kernel(seq):
        for pos, ids, mark in kernels.minimizers(seq, k, w, fold):
            yield [pos.astype("int32"), ids, mark]

    return kernels.per_sequence(seqs, kernels.identity(seqs), "pos int, kmer_id long, is_min int", kernel)


def seeds(seqs: DataFrame, k: int, w: int, fold: bool = True) -> DataFrame:
    """Rows (sample, seq_id, kmer_id): the minimizer k-mers of each sequence, each once a block."""

    def kernel(seq):
        for _, ids, mark in kernels.minimizers(seq, k, w, fold):
            yield [np.unique(ids[mark == 1])]

    return kernels.per_sequence(seqs, kernels.identity(seqs), "kmer_id long", kernel)


def seed_matches(query: DataFrame, reference: DataFrame, k: int, w: int, fold: bool = True) -> DataFrame:
    """Rows (query_id, reference_id, n_seeds): minimizer k-mers that two sequences share, each counted once.

    Seeds of the reference, up to SEED_ROWS, are an index that every task gets, and each query sequence is counted
    where it is read: neither its seeds nor the pairs they make are shuffled. Only if query ids repeat are seeds brought
    together by id first. A larger reference is joined; both sides then hold a k-mer once a sequence.
    Sequences of one id in several samples are told apart by query_sample and reference_sample.
    """
    ids, others = ([{"sample": f"{name}_sample", "seq_id": f"{name}_id"}[c] for c in kernels.identity(seqs)] for name, seqs in (("query", query), ("reference", reference)))
    named = lambda rows, name: rows.withColumnsRenamed({"sample": f"{name}_sample", "seq_id": f"{name}_id"})
    b = named(seeds(reference, k, w, fold).distinct(), "reference")
    held = b.limit(SEED_ROWS + 1).toArrow()
    if held.num_rows > SEED_ROWS:
        a = named(seeds(query, k, w, fold).distinct(), "query")
        return a.join(b, "kmer_id").groupBy(*ids, *others).agg(F.count("*").alias("n_seeds"))
    index = query.sparkSession.sparkContext.broadcast(_seed_index(held, others))
    made = ", ".join([*(f"{c} {t}" for c, t in b.dtypes if c in others), "n_seeds long"])
    own = kernels.identity(query)

    def whole(seqs):
        for block in _few(seqs, lambda s: _seeds_of(s, k, w, fold)):
            yield from _matches(index.value, *block)

    def gathered(sets):
        for block in _few(sets, lambda s: np.frombuffer(s, np.int64)):
            yield from _matches(index.value, *block)

    if not query.groupBy(*own).count().where("count > 1").limit(1).count():
        return named(kernels.per_batch(query, own, made, whole), "query")
    # Sets of ids travel as bytes, as sequences do.
    sets = seeds(query, k, w, fold).groupBy(*own).agg(F.collect_set("kmer_id").alias("ids"))
    packed = kernels.map_arrow(sets.select(*own, "ids"), _packed(own), ", ".join([*(f"{c} {t}" for c, t in sets.dtypes if c in own), "seq binary"]))
    return named(kernels.per_batch(packed, own, made, gathered), "query")


def _packed(own: list[str]):
    def run(batches):
        for b in batches:
            packed = pa.array([np.array(x, np.int64).tobytes() for x in b.column(len(own)).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(own))), packed], [*own, "seq"])

    return run


def _seeds_of(seq: bytes, k: int, w: int, fold: bool) -> np.ndarray:
    parts = [ids[mark == 1] for _, ids, mark in kernels.minimizers(seq, k, w, fold)]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)


def _few(seqs: list[bytes | None], made: Callable[[bytes], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, distinct ids) of sequences, some whole ones at a time."""
    rows, parts, size = [], [], 0
    for r, seq in enumerate(seqs):
        if seq is not None:
            rows.append(r)
            parts.append(made(seq))
            size += len(parts[-1])
        if parts and (size >= kernels.BLOCK or r == len(seqs) - 1):
            yield np.repeat(np.array(rows, np.int64), [len(p) for p in parts]), np.concatenate(parts)
            rows, parts, size = [], [], 0
    if parts:
        yield np.repeat(np.array(rows, np.int64), [len(p) for p in parts]), np.concatenate(parts)


def _seed_index(rows: pa.Table, names: list[str]) -> tuple[np.ndarray, np.ndarray, list[pa.Array]]:
    """(sorted k-mer ids, the number of the sequence each is of, columns that name the sequences)."""
    code = np.zeros(rows.num_rows, np.int64)
    columns = [rows.column(c).combine_chunks() for c in names]
    for c in columns:
        coded = c.dictionary_encode(null_encoding="encode")
        code = code * max(1, len(coded.dictionary)) + coded.indices.to_numpy(zero_copy_only=False)
    _, first, number = np.unique(code, return_index=True, return_inverse=True)
    ids = rows.column("kmer_id").to_numpy()
    order = np.argsort(ids, kind="stable")
    return ids[order], number[order], [c.take(pa.array(first)) for c in columns]


def _matches(index, rows: np.ndarray, ids: np.ndarray) -> Iterator[tuple[np.ndarray, list]]:
    """Counts by row and indexed sequence. A row meets an entry of the index once at most, so rows are taken until MEETINGS are due."""
    kmers, number, columns = index
    low = np.searchsorted(kmers, ids)
    times = np.searchsorted(kmers, ids, "right") - low
    met = times > 0
    rows, low, times = rows[met], low[met], times[met]
    due = np.cumsum(times)
    at = 0
    while at < len(rows):
        stop = np.searchsorted(due, (due[at - 1] if at else 0) + MEETINGS, "right")
        # Whole rows, one at least: as many as fit, else the first.
        stop = len(rows) if stop == len(rows) else max(np.searchsorted(rows, rows[stop]), np.searchsorted(rows, rows[at], "right"))
        n, base = times[at:stop], low[at:stop]
        place = np.arange(n.sum()) + np.repeat(base - (np.cumsum(n) - n), n)
        pair, count = np.unique(np.repeat(rows[at:stop], n) * len(columns[0]) + number[place], return_counts=True)
        named = pa.array(pair % len(columns[0]))
        yield pair // len(columns[0]), [*(c.take(named) for c in columns), count]
        at = stop
