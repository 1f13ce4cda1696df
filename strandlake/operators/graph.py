"""De Bruijn edges between consecutive k-mers of a sequence, and what follows from them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions import kmers as fn
from strandlake.operators import kernels, shred
from strandlake.operators.profile import running_sum, with_index


EDGE = "pos1 int, kmer_id1 long, kmer1 string, pos2 int, kmer_id2 long, kmer2 string"


def _edge_kernel(k: int, fold: bool, with_rank: bool):
    """Edges of the sequences of a batch; with ``with_rank`` each with its rank in its sequence, from ``first`` on."""

    def kernel(seqs, first=()):
        begin, last, passed = np.array(first, np.int64), -1, 0
        for block in kernels.laid(seqs, k + 1):
            data = kernels.codes(block.data)
            at, _ = kernels.positions_and_ids(data, k + 1, False)
            # Both ends are windows of the block; those without an edge are passed over.
            of, ends = kernels.positions_and_ids(data, k, fold)
            near = np.searchsorted(of, at)
            rows, start = block.place(at)
            rank = []
            if with_rank:
                # Rows rise, so edges of a sequence are neighbours; those of its earlier blocks have been passed.
                rank = [begin[rows] + np.arange(len(at)) - np.searchsorted(rows, rows) + np.where(rows == last, passed, 0)]
                end = block.rows[-1]
                last, passed = end, int((rows == end).sum()) + (passed if end == last else 0)
            yield rows, [*rank, start.astype(np.int32), ends[near], kernels.words(block.data, at, k), (start + 1).astype(np.int32), ends[near + 1] if len(at) else at, kernels.words(block.data, at + 1, k)]

    return kernel


def edges(seqs: DataFrame, k: int, ambiguous: str = "drop", fold: bool = True) -> DataFrame:
    """Rows (sample, seq_id, pos1, kmer_id1, kmer1, pos2, kmer_id2, kmer2): each k-mer and the one before it.

    A k-mer and its predecessor are in one sequence, so no window or self-join
    is needed. Dropped k-mers leave a gap; with 'expand' every expansion of one
    meets the fitting expansions of the other.
    """
    keep = kernels.identity(seqs)
    if ambiguous == "drop":
        return kernels.per_batch(seqs, keep, EDGE, _edge_kernel(k, fold, False))
    pairs = shred.windows(seqs, k + 1, tuple(keep)).select(*keep, F.col("pos").alias("pos1"), (F.col("pos") + 1).alias("pos2"), "kmer")
    own = F.when(F.col("kmer").rlike("^[ACGT]+$"), F.array("kmer")).otherwise(fn.expand(F.col("kmer")))
    pairs = pairs.withColumn("kmer", F.explode(own)).withColumn("kmer1", F.substring("kmer", 1, k)).withColumn("kmer2", F.col("kmer").substr(2, k))
    make = fn.canonical if fold else fn.encode
    return pairs.select(*keep, "pos1", make(F.col("kmer1")).alias("kmer_id1"), "kmer1", "pos2", make(F.col("kmer2")).alias("kmer_id2"), "kmer2")


def indexed_edges(seqs: DataFrame, k: int, fold: bool = True) -> DataFrame:
    """The edge list with a row number from 0 in order of sequence id, sample and position.

    Only sequences are numbered through: each one's first number is the sum of
    the edges before it, and its edges count on from there. Where an id repeats
    within a sample the edges themselves are numbered.
    """
    keep = kernels.identity(seqs)
    order = sorted(keep, reverse=True)

    def counted(seqs):
        total = np.zeros(len(seqs), np.int64)
        for block in kernels.laid(seqs, k + 1):
            bad = np.concatenate([[0], np.cumsum(kernels.codes(block.data) > 3)])
            total += np.bincount(block.place(np.flatnonzero(bad[k + 1 :] == bad[: -k - 1]))[0], minlength=len(seqs))
        found = np.flatnonzero(total)
        yield found, [total[found]]

    # Read several times below: one short row a sequence, kept so that the sequences are read once for it.
    sizes = kernels.per_batch(seqs, keep, "n long", counted).groupBy(*keep).agg(F.sum("n").alias("n"), F.count("*").alias("times")).persist()
    if sizes.where("times > 1").limit(1).count():
        sizes.unpersist()
        return with_index(edges(seqs, k, fold=fold), order[0], [*order[1:], "pos1"])
    first = running_sum(sizes.drop("times"), order, "n", "first").select(*keep, "first")
    on = [seqs[c].eqNullSafe(first[c]) for c in keep]
    placed = seqs.join(first, on, "inner").select(*[seqs[c] for c in keep], seqs["seq"], "first")
    return kernels.per_batch(placed, keep, f"idx long, {EDGE}", _edge_kernel(k, fold, True), ["first"])


def weighted_edges(seqs: DataFrame, k: int, ambiguous: str = "drop", fold: bool = True) -> DataFrame:
    """Rows (kmer_id1, kmer_id2, weight): (k+1)-mers are counted, and both ends taken from the distinct ones."""
    if ambiguous == "drop" and k < fn.MAX_K:
        whole = shred.profile_fast(seqs, k + 1, False)
        ends = F.shiftright("kmer_id", 2), F.col("kmer_id").bitwiseAND(F.lit(4**k - 1).cast("bigint"))
        first, second = (fn.canonical_id(e, k) if fold else e for e in ends)
        coded = whole.select(first.alias("kmer_id1"), second.alias("kmer_id2"), F.col("count").alias("n"))
        return coded.groupBy("kmer_id1", "kmer_id2").agg(F.sum("n").alias("weight"))
    counted = shred.windows(seqs, k + 1, ()).groupBy("kmer").agg(F.count("*").alias("n"))
    plain = F.col("kmer").rlike("^[ACGT]+$")
    counted = counted.where(plain) if ambiguous == "drop" else counted.withColumn("kmer", F.explode(F.when(plain, F.array("kmer")).otherwise(fn.expand(F.col("kmer")))))
    make = fn.canonical if fold else fn.encode
    coded = counted.select(make(F.substring("kmer", 1, k)).alias("kmer_id1"), make(F.col("kmer").substr(2, k)).alias("kmer_id2"), "n")
    return coded.groupBy("kmer_id1", "kmer_id2").agg(F.sum("n").alias("weight"))


def distinct_edges(edge_rows: DataFrame) -> DataFrame:
    return edge_rows.select("kmer_id1", "kmer_id2").distinct()


def nodes(edge_rows: DataFrame) -> DataFrame:
    """Rows (kmer_id, seq_id, sample, pos, kmer): where a node first shows, by sequence id, sample and position."""
    own = sorted(kernels.identity(edge_rows), reverse=True)
    end = lambda i: edge_rows.select(F.col(f"kmer_id{i}").alias("kmer_id"), F.struct(*own, F.col(f"pos{i}").alias("pos"), F.col(f"kmer{i}").alias("kmer")).alias("at"))
    return end(1).union(end(2)).groupBy("kmer_id").agg(F.min("at").alias("at")).select("kmer_id", "at.*")


def nodes_of(seqs: DataFrame, k: int, fold: bool = True) -> DataFrame:
    """``nodes(edges(seqs, k))`` without the edges: of each batch only where its nodes first show is shuffled."""
    keep = kernels.identity(seqs)
    own = sorted(keep, reverse=True)
    if not {t for c, t in seqs.dtypes if c in keep} <= {"string", "tinyint", "smallint", "int", "bigint"}:
        return nodes(edges(seqs, k, fold=fold))

    def run(batches):
        for b in batches:
            keys = pa.Table.from_batches([b]).select(own)
            # In order of identity, nulls first, as Spark compares; a repeated identity has a turn of its own.
            order = pc.sort_indices(keys, sort_keys=[(c, "ascending") for c in own], null_placement="at_start").to_pylist()
            listed = list(zip(*(keys.column(c).to_pylist() for c in own)))
            seqs, turns, times = b.column(len(keep)).cast(pa.binary()).to_pylist(), {}, {}
            for r in order:
                times[listed[r]] = times.get(listed[r], -1) + 1
                turns.setdefault(times[listed[r]], []).append(r)
            for turn in turns.values():
                yield from firsts(b, np.array(turn), [seqs[r] for r in turn])

    def firsts(b, turn, seqs):
        seen = np.zeros(0, np.int64)
        for block in kernels.laid(seqs, k + 1):
            data = kernels.codes(block.data)
            edge, _ = kernels.positions_and_ids(data, k + 1, False)
            met = np.zeros(len(data) + 1, bool)
            met[edge] = met[edge + 1] = True
            at, ids = kernels.positions_and_ids(data, k, fold)
            at, ids = at[met[at]], ids[met[at]]
            found, first = np.unique(ids, return_index=True)
            new = ~np.isin(found, seen, assume_unique=True)
            found, at = found[new], at[first[new]]
            seen = np.union1d(seen, found)
            rows, pos = block.place(at)
            rows = pa.array(turn[rows])
            yield pa.RecordBatch.from_arrays([pa.array(found), *(b.column(i).take(rows) for i in range(len(keep))), pa.array(pos.astype(np.int32)), kernels.words(block.data, at, k)], names)

    names = ["kmer_id", *keep, "pos", "kmer"]
    kinds = dict(seqs.dtypes)
    found = kernels.map_arrow(seqs.select(*keep, "seq"), run, ", ".join(["kmer_id long", *(f"{c} {kinds[c]}" for c in keep), "pos int, kmer string"]))
    return found.groupBy("kmer_id").agg(F.min(F.struct(*own, "pos", "kmer")).alias("at")).select("kmer_id", "at.*")


def degrees(weighted: DataFrame) -> DataFrame:
    """Rows (kmer_id, in_degree, out_degree, degree) of distinct edges; a loop counts on both sides."""
    ends = weighted.select(F.col("kmer_id1").alias("kmer_id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(weighted.select(F.col("kmer_id2").alias("kmer_id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("kmer_id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.sum(F.col("i") + F.col("o")).alias("degree"))


def smallest_degree(degree_rows: DataFrame) -> DataFrame:
    """One row: the least id among nodes of least degree."""
    return degree_rows.agg(F.min(F.struct("degree", "kmer_id")).alias("m")).select("m.kmer_id", "m.degree")


def augmented(edge_rows: DataFrame) -> DataFrame:
    """Each edge as a (k+1)-mer: its first k-mer and the last base of its second."""
    return edge_rows.select(*kernels.identity(edge_rows), F.col("pos1").alias("pos"), F.concat("kmer1", F.substring("kmer2", -1, 1)).alias("kmer"))


def second_order(seqs: DataFrame, k: int, fold: bool = True) -> DataFrame:
    """Weighted edges between consecutive (k+1)-mers."""
    return weighted_edges(seqs, k + 1, fold=fold)


def to_dot(weighted: DataFrame, path: str) -> None:
    """DOT lines of the edges, as text files."""
    line = F.format_string("  %d -> %d [weight=%d];", "kmer_id1", "kmer_id2", "weight")
    weighted.select(line.alias("value")).write.mode("overwrite").text(path)
