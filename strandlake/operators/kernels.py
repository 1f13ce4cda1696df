"""Numpy kernels over sequences, for Arrow batches: k-mer ids with positions, minimizers, edges, codons, log-odds.

A sequence is read in blocks, and short ones are laid end to end in blocks, so what a kernel holds grows neither with
a sequence nor with a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strandlake import alphabet as ab

#: Letters that are worked on at once, and rows of one batch that a kernel gives back.
BLOCK = 1 << 16
ROWS_OUT = 1 << 16
#: Bytes of one Arrow batch; a session's own setting goes first.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_LIMIT = "2097152"
#: The longest k-mers whose ids fit into 32 bits.
NARROW_K = 15

_AMINO = np.full(256, 255, np.uint8)
_AMINO[np.frombuffer(ab.AMINO_ACIDS.encode(), np.uint8)] = np.arange(len(ab.AMINO_ACIDS))
_TABLE = np.full(256, 4, np.uint8)
_TABLE[np.frombuffer(b"ACGT", np.uint8)] = np.arange(4)


def identity(seqs: DataFrame) -> list[str]:
    """The columns that tell sequences apart: a record id counts within its sample."""
    return [c for c in ("sample", "seq_id") if c in seqs.columns]


def map_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``df.mapInArrow`` with batches of bounded bytes, so that a Python worker's memory doesn't grow with the table."""
    spark = df.sparkSession
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, BATCH_LIMIT)
    return df.mapInArrow(run, schema)


def codes(seq: bytes) -> np.ndarray:
    """0..3 for A, C, G, T and 4 for any other letter."""
    return _TABLE[np.frombuffer(seq, np.uint8)]


def positions_and_ids(data: np.ndarray, k: int, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ids of all windows of ``k`` known letters, folded to the smaller strand if asked."""
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = np.int32 if k <= NARROW_K else np.int64
    bad = np.zeros(n, bool)
    unknown = np.flatnonzero(data > 3)
    for j in range(k):
        near = unknown - j
        bad[near[(near >= 0) & (near < n)]] = True
    letters = data.astype(kind)
    ids = np.zeros(n, kind)
    for j in range(k):
        ids <<= 2
        ids |= letters[j : j + n] & 3
    at = np.flatnonzero(~bad)
    ids = ids[at]
    if fold:
        # The other strand's id: letters in reverse order, each taken from 3.
        back, rest = np.zeros(len(ids), kind), ~ids
        for _ in range(k):
            back <<= 2
            back |= rest & 3
            rest >>= 2
        ids = np.minimum(ids, back)
    return at, ids.astype(np.int64)


@dataclass
class Laid:
    """Pieces of sequences laid end to end with a break after each: ``data`` are their bytes, ``rows`` the sequences they
    are of, ``starts`` where they begin in ``data`` and ``offsets`` where in their sequence."""

    data: np.ndarray
    rows: np.ndarray
    starts: np.ndarray
    offsets: np.ndarray

    def place(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, positions in their sequences) of places in ``data``."""
        piece = np.repeat(np.arange(len(self.rows)), np.diff(self.starts, append=len(self.data) + 1))[at]
        return self.rows[piece], at - self.starts[piece] + self.offsets[piece]

    def whole(self, k: int) -> np.ndarray:
        """Places of all windows of ``k`` letters that lie in one piece, whatever the letters."""
        lengths = np.diff(self.starts, append=len(self.data) + 1) - 1
        fits = np.maximum(lengths - k + 1, 0)
        return np.arange(fits.sum()) + np.repeat(self.starts - (np.cumsum(fits) - fits), fits)


def laid(seqs: list[bytes | None], k: int) -> Iterator[Laid]:
    """All sequences of at least ``k`` letters, in order, in blocks of about BLOCK letters.

    Pieces of a long one overlap by k - 1, so that every window is in just one.
    """
    parts, rows, offsets, size = [], [], [], 0

    def block():
        lengths = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
        return Laid(np.frombuffer(b"\n".join(parts), np.uint8), np.array(rows, np.int64), np.cumsum(lengths) - lengths, np.array(offsets, np.int64))

    for r, seq in enumerate(seqs):
        if seq is None:
            continue
        for at in range(0, len(seq) - k + 1, BLOCK):
            parts.append(seq[at : at + BLOCK + k - 1])
            rows.append(r)
            offsets.append(at)
            size += len(parts[-1])
            if size >= BLOCK:
                yield block()
                parts, rows, offsets, size = [], [], [], 0
    if parts:
        yield block()


def blocks(seq: bytes, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(offset, codes) of pieces that overlap by k - 1, so that every window is in just one."""
    for at in range(0, max(1, len(seq) - k + 1), BLOCK):
        yield at, codes(seq[at : at + BLOCK + k - 1])


def minimizers(seq: bytes, k: int, w: int, fold: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(positions, ids, marks) block by block; marked is what is first and least of some ``w`` k-mers in a row.

    Fewer than ``w`` k-mers are one window. The last w - 1 k-mers of a block wait for the next.
    """
    pos, ids, mark, whole = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), False
    for at, data in blocks(seq, k):
        own, own_ids = positions_and_ids(data, k, fold)
        pos, ids, mark = np.append(pos, own + at), np.append(ids, own_ids), np.append(mark, np.zeros(len(own), np.int32))
        n = len(ids) - w + 1
        if n <= 0:
            continue
        whole = True
        mark[np.lib.stride_tricks.sliding_window_view(ids, w).argmin(axis=1) + np.arange(n)] = 1
        yield pos[:n], ids[:n], mark[:n]
        pos, ids, mark = pos[n:], ids[n:], mark[n:]
    if len(ids):
        if not whole:
            mark[ids.argmin()] = 1
        yield pos, ids, mark


def amino_counts(seq: bytes, k: int) -> Iterator[list]:
    """Ids of amino-acid k-mers, five bits a residue, and how often each is in a block."""
    for at in range(0, max(0, len(seq) - k + 1), BLOCK):
        data = _AMINO[np.frombuffer(seq[at : at + BLOCK + k - 1], np.uint8)]
        n = len(data) - k + 1
        ids, bad = np.zeros(n, np.int64), np.zeros(n, bool)
        for j in range(k):
            c = data[j : j + n].astype(np.int64)
            bad |= c == 255
            ids = ids << 5 | c
        yield list(np.unique(ids[~bad], return_counts=True))


def words(seq: bytes | np.ndarray, starts: np.ndarray, k: int) -> pa.Array:
    """The ``k`` letters from each of ``starts`` on, as strings."""
    if not len(starts):
        return pa.array([], pa.string())
    data = seq if isinstance(seq, np.ndarray) else np.frombuffer(seq, np.uint8)
    letters = np.lib.stride_tricks.sliding_window_view(data, k)[starts]
    offsets = np.arange(len(starts) + 1, dtype=np.int32) * k
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(letters)))


def per_batch(seqs: DataFrame, keep: list[str], made: str, kernel: Callable[..., Iterator[tuple[np.ndarray, list]]], more: list[str] = ()) -> DataFrame:
    """Rows (*keep, made): what ``kernel(seqs, *more)`` gives for the sequences of a batch, as (rows, equally long arrays).

    The kernel gets lists, with null sequences as None; ``rows`` say which sequence's ``keep`` columns a result has.
    """
    kinds = dict(seqs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), made])
    names = [*keep, *(part.split()[0] for part in made.split(", "))]
    width = len(keep)

    def run(batches):
        for b in batches:
            own = [b.column(i) for i in range(width)]
            extra = [b.column(width + 1 + i).to_pylist() for i in range(len(more))]
            for rows, arrays in kernel(b.column(width).cast(pa.binary()).to_pylist(), *extra):
                for i in range(0, len(rows), ROWS_OUT):
                    cut = pa.array(rows[i : i + ROWS_OUT])
                    yield pa.RecordBatch.from_arrays([*(c.take(cut) for c in own), *(_arrow(x[i : i + ROWS_OUT]) for x in arrays)], names)

    return map_arrow(seqs.select(*keep, "seq", *more), run, schema)


def per_sequence(seqs: DataFrame, keep: list[str], made: str, kernel: Callable[..., Iterator[list]], more: list[str] = ()) -> DataFrame:
    """Rows (*keep, made): what ``kernel(seq, *more)`` gives for every sequence, as lists of equally long arrays.

    ``keep`` columns are repeated for each row. Null sequences give none.
    Results of short sequences leave together in larger batches.
    """
    kinds = dict(seqs.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in keep), made])
    names = [*keep, *(part.split()[0] for part in made.split(", "))]
    width = len(keep)

    def run(batches):
        for b in batches:
            types = [b.schema.field(i).type for i in range(width)]
            extra = [b.column(width + 1 + i).to_pylist() for i in range(len(more))]
            rows, parts, size = [], [], 0

            def flush():
                counts = np.array([len(p[0]) for _, p in parts], np.int64)
                row = pa.array(np.repeat(np.array([r for r, _ in parts], np.int64), counts))
                own = [b.column(i).take(row) for i in range(width)]
                made_columns = [pa.concat_arrays([_arrow(p[j]) for _, p in parts]) for j in range(len(parts[0][1]))]
                return pa.RecordBatch.from_arrays([*(c.cast(t) for c, t in zip(own, types)), *made_columns], names)

            for r, seq in enumerate(b.column(width).cast(pa.binary())):
                if not seq.is_valid:
                    continue
                for arrays in kernel(seq.as_py(), *(x[r] for x in extra)):
                    if len(arrays[0]):
                        parts.append((r, arrays))
                        size += len(arrays[0])
                    if size >= ROWS_OUT:
                        yield flush()
                        parts, size = [], 0
            if parts:
                yield flush()

    return map_arrow(seqs.select(*keep, "seq", *more), run, schema)


def _arrow(x) -> pa.Array:
    return x if isinstance(x, pa.Array) else pa.array(x)
