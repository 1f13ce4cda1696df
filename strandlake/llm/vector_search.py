"""Operator 9, approximate nearest neighbours by anisotropic quantisation.

Codebooks are fitted on a bounded sample; every vector is encoded. A chunk of
queries meets the candidates in blocks that stream through a task: a block's
four-bit codes are scanned by table lookups, and all that are within their
quantisation error of a query's nearest are scored exactly and merged into the
best so far. No nearer candidate is lost, however many tie in a crowd of copies.
A chunk's candidates are dealt to shards, more of them for a larger table, so no
task grows with the table. Every chunk reads all
vectors once: a table of n vectors is copied n / (20 CHUNK) times.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm import anisotropic as aq
from strandlake.llm.common import cut, map_arrow

#: Neighbours of a query, rows that fit the codebooks (on average, where there are more), rows a block, queries a chunk,
#: shards of FEW_ROWS candidates up to SHARDS and of SHARD_ROWS beyond, queries scanned at once, products made at once.
NEIGHBOURS = 20
FIT_ROWS = 4096
BLOCK = 1024
CHUNK = 16_384
SHARDS = 16
FEW_ROWS = 5000
SHARD_ROWS = 100_000
SCAN = 64
PRODUCTS = 1 << 21


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows (vec_id, v) with finite, non-null, non-zero vectors of the commonest length; one row an id (the least vector)."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    kept = rows.where(F.col(id_col).isNotNull() & v.isNotNull() & fine).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    one = cut(kept.groupBy("vec_id").agg(F.min("v").alias("v")))
    sizes = one.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    return one.where(F.size("v") == (sizes[0].d if sizes else 0))


def _rows(column) -> np.ndarray:
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    return flat.reshape(len(column), -1)


def search(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, neighbours: int = NEIGHBOURS) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for each vector whose id is divisible by ``every`` its nearest others.

    score is the inner product in double precision; ties go to the smaller id;
    a query with fewer candidates gets them all. Vectors null, zero or holding
    null or non-finite parts, of another length than most, or without an id take
    no part; rows that repeat an id count once; no rows give none.
    """
    all_rows = usable(rows, id_col, vector_col)
    n = all_rows.count()
    picked = F.lit(True) if n <= FIT_ROWS else F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(FIT_ROWS / n * (1 << 30))
    sample = sorted(all_rows.where(picked).select(F.xxhash64("vec_id").alias("h"), "vec_id", "v").collect())
    books = aq.fit(np.array([r.v for r in sample], np.float64)) if sample else np.zeros((2, aq.ENTRIES, aq.WIDTH))
    chunks = max(1, math.ceil(n / every / CHUNK))
    shards = max(1, min(SHARDS, math.ceil(n / FEW_ROWS)), math.ceil(n / SHARD_ROWS))
    eta = aq.eta_of(len(books) * aq.WIDTH)

    def encode(batches):
        for b in batches:
            codes = aq.pack(aq.assign(aq.pad(_rows(b.column(1))), books, eta)) if b.num_rows else np.zeros((0, 1), np.uint8)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c.tobytes() for c in codes], pa.binary())], ["vec_id", "v", "codes"])

    coded = map_arrow(all_rows, encode, "vec_id long, v array<double>, codes binary")
    shard = F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(shards)).cast("int").alias("shard")
    chunk = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(chunks)).cast("int").alias("chunk")
    numbers = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    stored = coded.select("*", shard).select(numbers(chunks).alias("chunk"), "shard", F.lit(1).alias("kind"), "vec_id", "v", "codes")
    asked = all_rows.where(F.col("vec_id") % every == 0).select("*", chunk)
    asked = asked.select("chunk", numbers(shards).alias("shard"), F.lit(0).alias("kind"), "vec_id", "v", F.lit(None).cast("binary").alias("codes"))

    def meet(batches):
        key, group = None, None
        for b in batches:
            of = np.stack([b.column(k).to_numpy() for k in range(3)]) if b.num_rows else np.zeros((3, 0), int)
            ends = [*(np.flatnonzero((of[:, 1:] != of[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
            at = 0
            for end in ends:
                if end > at:
                    if (new := tuple(of[:2, at].tolist())) != key:
                        if group is not None:
                            yield group.found()
                        key, group = new, Nearest(books, neighbours)
                    part = b.slice(at, end - at)
                    ids, x = part.column(3).to_numpy(), _rows(part.column(4))
                    if of[2, at] == 0:
                        group.ask(ids, x)
                    else:
                        for k in range(0, len(ids), BLOCK):
                            group.offer(ids[k : k + BLOCK], x[k : k + BLOCK], part.column(5).slice(k, BLOCK).to_pylist())
                at = end
        if group is not None:
            yield group.found()

    dealt = stored.unionByName(asked).repartition("chunk", "shard").sortWithinPartitions("chunk", "shard", "kind", "vec_id")
    met = map_arrow(dealt, meet, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank.cast("int")).where(F.col("rank") <= neighbours).select("query_id", "rank", "vec_id", "score")


def _within(near: np.ndarray, error: np.ndarray, may: np.ndarray, worst: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``may`` can be among the ``n`` largest (queries x rows), and the least score of these.

    Scores are within ``error`` of ``near``; ``worst`` is a score that n others reach already.
    """
    if near.shape[1] > n:
        sure = np.where(may, near - error, -np.inf)
        sure[np.isnan(sure)] = -np.inf
        worst = np.maximum(worst, np.partition(sure, -n, axis=1)[:, -n, None])
    return may & ~(near + error < worst), worst


class Nearest:
    """The best candidates so far of a chunk of queries; candidates come in blocks."""

    def __init__(self, books: np.ndarray, neighbours: int):
        self.books, self.neighbours = books, neighbours
        self.asking: list[np.ndarray] = []
        self.queries: list[np.ndarray] = []
        self.best_ids = self.best = None
        #: Pairs of a query and a candidate met, and those of them that were scored exactly.
        self.met = self.scored = 0

    def ask(self, ids: np.ndarray, x: np.ndarray) -> None:
        self.asking.append(ids)
        self.queries.append(x)

    def _settle(self) -> None:
        if self.best is None:
            self.ids = np.concatenate(self.asking) if self.asking else np.zeros(0, np.int64)
            self.x = np.concatenate(self.queries) if self.queries else np.zeros((0, 1))
            self.best = np.full((len(self.ids), self.neighbours), -np.inf)
            self.best_ids = np.full(self.best.shape, np.iinfo(np.int64).max)

    def offer(self, ids: np.ndarray, x: np.ndarray, codes: list[bytes]) -> None:
        self._settle()
        packed = np.frombuffer(b"".join(codes), np.uint8).reshape(len(ids), -1)
        size = np.linalg.norm(x, axis=1)
        error = aq.error(x, packed, self.books)
        n = self.neighbours
        for k in range(0, len(self.ids), SCAN):
            q, own = self.x[k : k + SCAN], self.ids[k : k + SCAN, None]
            norm = np.linalg.norm(q, axis=1)[:, None]
            may = ids != own
            worst = self.best[k : k + SCAN, -1:]
            near = aq.scan(packed, aq.tables(q, self.books))
            may, worst = _within(near, norm * error, may, worst, n)
            cols = np.flatnonzero(may.any(axis=0))
            rounding = (x.shape[1] + 2) * 4e-16 * norm * size[cols]
            may, _ = _within(q @ x[cols].T, rounding, may[:, cols], worst, n)
            row, col = np.nonzero(may)
            col = cols[col]
            self.met, self.scored = self.met + near.size, self.scored + len(row)
            step = max(1, PRODUCTS // x.shape[1])
            exact = [(x[col[i : i + step]] * q[row[i : i + step]]).sum(axis=1) for i in range(0, len(row), step)]
            row = np.concatenate([np.repeat(np.arange(len(q)), n), row])
            names = np.concatenate([self.best_ids[k : k + SCAN].ravel(), ids[col]])
            scores = np.concatenate([self.best[k : k + SCAN].ravel(), *exact])
            order = np.lexsort((names, -scores, row))
            order = order[np.searchsorted(row[order], np.arange(len(q)))[:, None] + np.arange(n)]
            self.best[k : k + SCAN], self.best_ids[k : k + SCAN] = scores[order], names[order]

    def found(self) -> pa.RecordBatch:
        self._settle()
        row, col = np.nonzero(np.isfinite(self.best) | (self.best_ids < np.iinfo(np.int64).max))
        return pa.RecordBatch.from_arrays([pa.array(self.ids[row]), pa.array(self.best_ids[row, col]), pa.array(self.best[row, col])], ["query_id", "vec_id", "score"])
