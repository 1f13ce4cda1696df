"""Operator 7, SimHash near-dedup by a byte-position index with count filtering.

A 64-bit fingerprint is eight positional bytes. Fingerprints that differ in at
most three bits differ in at most three bytes, so at least five positional
bytes are shared. Any five of eight positions hold three positions of the
first half or three of the last half, so postings keyed by the eight such
positional byte triples meet every wanted pair. The shared positional bytes of
each pair met are tallied, pairs below five go, and the bits verify the rest.

Postings of one byte alone would meet n*n/256 pairs; three bytes meet
n*n/2**24. Postings longer than ``posting_limit`` are not paired at once: their
members are posted again by all five-byte subsets, and what is still too long
by the fingerprint with each choice of three free bits cleared, where sharing a
posting already proves the link and a star replaces the pairs. No link is lost
and no posting is gathered beyond the limit.
"""

from __future__ import annotations

from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import bounded, cut, fresh, map_arrow, packed
from strandlake.llm.components import connected_components
from strandlake.llm.fingerprints import simhash

MAX_BITS = 3
MIN_BYTES = 8 - MAX_BITS
POSTING_LIMIT = 256


def _byte_mask(positions: tuple[int, ...]) -> int:
    return sum(0xFF << (8 * p) for p in positions)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


TRIPLES = [_byte_mask(c) for half in (range(4), range(4, 8)) for c in combinations(half, 3)]
FIVES = [_byte_mask(c) for c in combinations(range(8), MIN_BYTES)]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, key, fp) for every row of ``docs``: ``key`` is the 64-bit hash of the text; a null text counts as empty."""

    def run(batches):
        for b in batches:
            text = b.column(2).cast(pa.binary())
            fps = [_signed(simhash(t.as_py())) for t in text]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(fps, pa.int64())], ["doc_id", "key", "fp"])

    text = F.col(text_col).cast("string")
    rows = packed(docs).select(F.col(id_col).cast("long").alias("doc_id"), _key(text).alias("key"), text.alias("text"))
    return map_arrow(rows, run, "doc_id long, key long, fp long")


def _key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def _post(nodes: DataFrame, masks: list[int]) -> DataFrame:
    """Postings (slot, key, fp, m): each fingerprint under each masked value."""
    entries = F.array(*[F.struct(F.lit(i).alias("slot"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)])
    return nodes.select("fp", "m", F.explode(entries).alias("e")).select("e.slot", "e.key", "fp", "m")


def _near(a: Column, b: Column) -> Column:
    """Count filter, then bits: at least five shared positional bytes and at most three differing bits."""
    x = a.bitwiseXOR(b)
    shared = sum(F.when(x.bitwiseAND(F.lit(_signed(0xFF << (8 * p)))) == 0, 1).otherwise(0) for p in range(8))
    return (shared >= MIN_BYTES) & (F.bit_count(x) <= MAX_BITS)


def _pairs(postings: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """Links (u, v) met in postings of up to ``limit`` members, and the nodes of longer postings."""
    sizes = postings.groupBy("slot", "key").agg(F.count("*").alias("n")).where("n > 1")
    sized = postings.join(sizes, ["slot", "key"])
    short, long = sized.where(F.col("n") <= limit), sized.where(F.col("n") > limit)
    lists = short.groupBy("slot", "key").agg(F.sort_array(F.collect_list(F.struct("fp", "m"))).alias("g"))
    heads = lists.select(F.posexplode("g").alias("i", "a"), "g")
    near = F.filter(F.slice("g", F.col("i") + 2, F.size("g")), lambda b: _near(F.col("a.fp"), b["fp"]))
    links = heads.select(F.col("a.m").alias("u"), F.explode(near).alias("b")).select("u", F.col("b.m").alias("v"))
    return links, long.select("fp", "m", "slot", "key")


def _stars(members: DataFrame) -> DataFrame:
    """Links for postings too long even by five bytes: clear every three of their 24 free bits, link to the least."""
    free = [(0xFF << (8 * p)) for p in range(8)]

    def masks_of(five: int) -> list[int]:
        bits = [p * 8 + k for p in range(8) if not five & free[p] for k in range(8)]
        return [_signed(~sum(1 << b for b in c) & ((1 << 64) - 1)) for c in combinations(bits, MAX_BITS)]

    parts = None
    for slot, five in enumerate(FIVES):
        keys = F.transform(F.array(*[F.lit(m) for m in masks_of(five)]), lambda m: F.col("fp").bitwiseAND(m))
        rows = members.where(F.col("slot") == slot).select("m", F.posexplode(keys).alias("mask", "masked"), F.lit(slot).alias("slot"))
        parts = rows if parts is None else parts.union(rows)
    least = parts.groupBy("slot", "mask", "masked").agg(F.min("m").alias("v"), F.count("*").alias("n")).where("n > 1")
    return parts.join(least, ["slot", "mask", "masked"]).select(F.col("m").alias("u"), "v")


def links(nodes: DataFrame, posting_limit: int = POSTING_LIMIT, n: int | None = None) -> DataFrame:
    """Links (u, v) among ``nodes`` (fp long distinct, m long): every pair within three bits is connected; ``n`` is their number, if known."""
    found, long = _pairs(_post(nodes, TRIPLES), posting_limit)
    long = cut(long.select("fp", "m").distinct(), n)
    if long.isEmpty():
        return found
    more, longer = _pairs(_post(long, FIVES), posting_limit)
    longer = cut(longer, n and n * len(FIVES))
    found = found.union(more)
    return found if longer.isEmpty() else found.union(_stars(longer))


def _grouped(rows: DataFrame, posting_limit: int) -> DataFrame:
    """Rows (fp, group, least): one a fingerprint of ``rows`` that have ids; ``least`` is the least id of the group."""
    nodes = cut(rows.where(F.col("doc_id").isNotNull()).groupBy("fp").agg(F.min("doc_id").alias("m")), rows.count())
    n = nodes.count()
    comps = connected_components(links(nodes.select("fp", F.col("fp").alias("m")), posting_limit, n), nodes=n)
    placed = cut(nodes.join(comps, nodes.fp == comps.node, "left").select("fp", "m", F.coalesce("component", "fp").alias("group")), n)
    return placed.join(placed.groupBy("group").agg(F.min("m").alias("least")), "group").select("fp", "group", "least")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", posting_limit: int = POSTING_LIMIT) -> DataFrame:
    """One row (doc_id, fingerprint, component_id) per row of ``docs``.

    fingerprint: 16 lowercase hex digits; component_id: least id among the rows
    reachable over links of at most three differing bits. Null and empty texts
    have the zero fingerprint, linked like any other. Repeated rows come out as
    often as they come in; unlike texts under one id aren't linked by the id; a
    null id keeps its row and takes the component of the ids that share its
    fingerprint (null if there are none). No rows give no rows. Equal
    fingerprints are one node, so a group of exact copies costs one node. Jobs
    run when this is called; the result is lazy.
    """
    rows = cut(fingerprints(docs, id_col, text_col))
    of_fp = _grouped(rows, posting_limit)
    return rows.join(of_fp, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("least").alias("component_id"))


def keep_one_per_group(docs: DataFrame, posting_limit: int = POSTING_LIMIT) -> DataFrame:
    """One row of ``docs`` of each group of near duplicates, that of the least doc_id; columns stay as they are.

    Unlike texts under one id are in groups of their own, so none is lost; of
    unlike texts of one group under its least id, that of the least text hash
    stays, and of rows with the same id and text one. Null and empty texts are one group.
    Rows with a null doc_id can't be told apart by it and all stay. No rows give
    none. Only ids and hashes are grouped; whole texts are shuffled only when too
    many rows go for their ids to be broadcast.
    """
    rows = cut(fingerprints(docs).where(F.col("doc_id").isNotNull()))
    of_fp = _grouped(rows, posting_limit)
    texts = rows.groupBy("fp", "doc_id", "key").agg(F.count("*").alias("n"))
    per_fp = texts.groupBy("fp").agg(F.min(F.struct("doc_id", "key")).alias("first")).join(of_fp, "fp")
    kept = per_fp.groupBy("group").agg(F.min("first").alias("first")).select("first.doc_id", "first.key", F.lit(True).alias("keep"))
    own_id, own_key, other_id, other_key, stays = fresh(docs, "own_id", "own_key", "other_id", "other_key", "stays")
    known = texts.join(kept, ["doc_id", "key"], "left").select(F.col("doc_id").alias(other_id), F.col("key").alias(other_key), F.coalesce("keep", F.lit(False)).alias(stays), "n")
    # The rows that go, and those that are there more than once.
    odd = cut(known.where(~F.col(stays) | (F.col("n") > 1)).drop("n"), rows.count())
    goes, twice = odd.where(~F.col(stays)).drop(stays), odd.where(stays).drop(stays)
    keyed = packed(docs).withColumns({own_id: F.col("doc_id").cast("long"), own_key: _key(F.col("text"))})
    on = (F.col(own_id) == F.col(other_id)) & (F.col(own_key) == F.col(other_key))
    left = keyed.join(bounded(goes), on, "left_anti")
    if twice.isEmpty():
        return left.select(docs.columns)
    single = left.join(bounded(twice), on, "left_anti").select(docs.columns)
    repeated = left.join(bounded(twice), on, "left_semi").dropDuplicates([own_id, own_key]).select(docs.columns)
    return single.unionByName(repeated)
