"""Profiles: frequencies, statistics, nullomers, histograms, views and headers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions import kmers as fn
from strandlake.operators import shred

#: Rows are numbered inside buckets of so many rows, if these are not too many; samples that set one border.
BUCKET_ROWS = 1_000_000
MOST_BUCKETS = 256
SAMPLES_A_BUCKET = 32


def universe_size(k: int, fold: bool = True) -> int:
    """Number of k-mers; with strands folded, of pairs and palindromes."""
    return (4**k + (4 ** (k // 2) if k % 2 == 0 else 0)) // 2 if fold else 4**k


def universe(spark, k: int, fold: bool = True) -> DataFrame:
    """Rows (kmer_id): every id; with ``fold`` those that are their own canonical id."""
    ids = spark.range(4**k).select(F.col("id").alias("kmer_id"))
    return ids.where(fn.canonical(fn.decode(F.col("kmer_id"), k)) == F.col("kmer_id")) if fold else ids


def with_frequency(profile: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds count / total of the profile (or of each group), from one small aggregate rather than a window."""
    total = profile.groupBy(*by).agg(F.sum("count").alias("__total"))
    joined = profile.join(total, list(by)) if by else profile.crossJoin(F.broadcast(total))
    return joined.withColumn("frequency", F.col("count") / F.col("__total")).drop("__total")


def nullomers(profile: DataFrame, k: int, fold: bool = True) -> DataFrame:
    """Ids of the universe that the profile lacks."""
    return universe(profile.sparkSession, k, fold).join(profile.select("kmer_id"), "kmer_id", "left_anti")


def histogram(profile: DataFrame, above: int = 2) -> DataFrame:
    """Rows (count, n_kmers) of counts above ``above``; the usual 2 leaves out single and double k-mers."""
    return profile.where(F.col("count") > above).groupBy("count").agg(F.count("*").alias("n_kmers"))


def argmax(rows: DataFrame, key: str, value: str) -> DataFrame:
    """One row: the first key with the largest value, and that value."""
    best = F.max_by(F.struct(F.col(key), F.col(value)), F.struct(F.col(value), (-F.col(key)).alias("k")))
    return rows.agg(best.alias("b")).select(F.col(f"b.{key}").alias(key), F.col(f"b.{value}").alias(value))


def coverage(profile: DataFrame, above: int = 2) -> DataFrame:
    """The histogram's peak: its count and its height."""
    return argmax(histogram(profile, above), "count", "n_kmers").select(F.col("count").alias("peak_count"), F.col("n_kmers").alias("peak_height"))


def file_stats(seqs: DataFrame, k: int, fold: bool = True) -> DataFrame:
    """Per sample: reads, k-mers, unique k-mers, nullomers (exact and as 4^k - unique), read lengths."""
    reads = seqs.groupBy("sample").agg(
        F.count("*").alias("total_reads"), F.min(F.length("seq")).alias("min_read_length"), F.max(F.length("seq")).alias("max_read_length"),
        F.floor(F.sum(F.length("seq").cast("long")) / F.count("*")).cast("int").alias("avg_read_length"),
    )
    own = shred.profile_fast(seqs, k, fold, ("sample",)).groupBy("sample").agg(F.sum("count").alias("total_kmers"), F.count("*").alias("unique_kmers"))
    joined = reads.join(own, "sample", "left").na.fill(0, ["total_kmers", "unique_kmers"])
    return joined.withColumn("nullomers", F.lit(universe_size(k, fold)) - F.col("unique_kmers")).withColumn("nullomers_compat", F.lit(4**k) - F.col("unique_kmers"))


def totals(profile: DataFrame, k: int, fold: bool = True) -> DataFrame:
    """One row: k, total and unique k-mers, nullomers exact and by the halved universe."""
    half = 4**k // 2 if fold else 4**k
    sums = profile.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total_kmers"), F.count("*").alias("unique_kmers"))
    return sums.select(
        F.lit(k).alias("k"), "total_kmers", "unique_kmers", (F.lit(universe_size(k, fold)) - F.col("unique_kmers")).alias("nullomers"), (F.lit(half) - F.col("unique_kmers")).alias("unique_nullomers_compat")
    )


def header(profile: DataFrame, stats: DataFrame, k: int, fold: bool = True, tags: tuple[str, ...] = (), comments: tuple[str, ...] = ()) -> DataFrame:
    """One row: the totals with the statistics of every input file."""
    text = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    files = stats.agg(F.sort_array(F.collect_list(F.struct(*sorted(stats.columns)))).alias("files"))
    return totals(profile, k, fold).crossJoin(files).select("*", F.lit(False).alias("sorted"), text(tags).alias("tags"), text(comments).alias("comments"))


def header_json(row: DataFrame) -> DataFrame:
    return row.select(F.to_json(F.struct(*row.columns)).alias("header"))


def view(profile: DataFrame, order: str = "id", min_count: int = 0) -> DataFrame:
    """Rows above ``min_count`` (2 drops single and double k-mers), by id or by falling count."""
    kept = profile.where(F.col("count") > min_count)
    return kept.orderBy("kmer_id") if order == "id" else kept.orderBy(F.desc("count"), "kmer_id")


def _bucketed(rows: DataFrame, keys: list[Column | str]) -> DataFrame:
    """``rows`` with ``__b``, a bucket number that rises with ``keys`` and holds about BUCKET_ROWS rows.

    Borders are quantiles of keys picked by their hash, so they are the same in
    every run, and skewed or textual keys are dealt evenly. The number of
    buckets is bounded, and so is the sample that comes to the driver.
    """
    n = rows.count()
    buckets = min(MOST_BUCKETS, math.ceil(n / BUCKET_ROWS))
    if buckets <= 1:
        return rows.withColumn("__b", F.lit(0))
    key = F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(f"k{i}") for i, c in enumerate(keys)])
    every = max(1, n // (buckets * SAMPLES_A_BUCKET))
    sample = rows.select(key.alias("k")).where(F.pmod(F.xxhash64("k"), F.lit(every)) == 0).orderBy("k").limit(4 * buckets * SAMPLES_A_BUCKET)
    ranked = sample.agg(F.sort_array(F.collect_list("k")).alias("all"))
    size, step = F.size("all"), F.greatest(F.lit(1), F.floor(F.size("all") / buckets)).cast("int")
    borders = ranked.select(F.filter(F.col("all"), lambda k, i: (i % step == 0) & (i > 0)).alias("__borders")).where(size >= 0)
    placed = rows.crossJoin(F.broadcast(borders))
    return placed.withColumn("__b", F.size(F.filter("__borders", lambda b: b <= key))).drop("__borders")


def _before(placed: DataFrame, worth: Column) -> DataFrame:
    """Rows (__b, __o): the sum of ``worth`` over all earlier buckets."""
    sizes = placed.groupBy("__b").agg(F.sum(worth).alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return F.broadcast(sizes.select("__b", earlier.cast("long").alias("__o")))


def with_index(rows: DataFrame, lead: str, order: list[Column | str], name: str = "idx") -> DataFrame:
    """Numbers rows from 0 in order of (lead, *order), of any types that can be ordered.

    Rows are numbered inside buckets of about equal size; a bucket's offset is
    the count of those before it.
    """
    placed = _bucketed(rows, [lead, *order])
    inside = F.row_number().over(Window.partitionBy("__b").orderBy(lead, *order))
    numbered = placed.withColumn("__r", inside).join(_before(placed, F.lit(1)), "__b")
    return numbered.withColumn(name, F.col("__o") + F.col("__r") - 1).drop("__b", "__r", "__o")


def running_sum(rows: DataFrame, order: list[str], worth: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``worth`` over all rows before, in order of ``order``; computed like ``with_index``."""
    placed = _bucketed(rows, order)
    inside = F.sum(worth).over(Window.partitionBy("__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    summed = placed.withColumn("__r", F.coalesce(inside, F.lit(0))).join(_before(placed, F.col(worth)), "__b")
    return summed.withColumn(name, F.col("__o") + F.col("__r")).drop("__b", "__r", "__o")


def shuffle(profile: DataFrame, seed: int = 42) -> DataFrame:
    """The rows in a seeded random order, numbered anew: ordered by a hash of id and seed, the same on every run."""
    keyed = profile.withColumn("__h", F.md5(F.concat_ws(":", "kmer_id", F.lit(seed))))
    return with_index(keyed, "__h", ["kmer_id"]).drop("__h")
