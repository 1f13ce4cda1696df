"""Pairwise similarities and distances of samples over the full universe of k-mers.

Profiles stay sparse. What absent k-mers add follows from sums of each sample
and from the size of the universe, so only k-mers that both samples of a pair
hold are joined. Two metrics need the k-mers that one sample lacks as well:
chebyshev and seuclidean handle them with zero-filled observed k-mers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIMILARITIES = ("pearson", "spearman", "d2", "matching_share")
METRICS = (
    "pearson", "spearman", "correlation", "cosine", "euclidean", "sqeuclidean", "seuclidean", "cityblock", "chebyshev", "minkowski",
    "braycurtis", "canberra", "hamming", "matching", "jaccard", "jaccard_counts", "dice", "jensenshannon", "kulsinski", "rogerstanimoto",
    "russellrao", "sokalmichener", "sokalsneath", "yule", "d2", "matching_share", "likelihood_ratio", "emd",
)


def _pairs(samples: DataFrame) -> DataFrame:
    a, b = samples.select(F.col("sample").alias("sample_a")), samples.select(F.col("sample").alias("sample_b"))
    return a.join(F.broadcast(b), F.col("sample_a") < F.col("sample_b"))


def _met(long: DataFrame, columns: list[str]) -> DataFrame:
    """k-mers that both samples of a pair hold, with both sides' columns as a_* and b_*."""
    side = lambda s: long.select("kmer_id", F.col("sample").alias(f"sample_{s}"), *[F.col(c).alias(f"{s}_{c}") for c in columns])
    return side("a").join(side("b"), "kmer_id").where(F.col("sample_a") < F.col("sample_b"))


def _correlation(n: Column, su: Column, sv: Column, suu: Column, svv: Column, suv: Column) -> Column:
    """Pearson's r from sums; null where a sample does not vary."""
    top = n * suv - su * sv
    low = F.sqrt(n * suu - su * su) * F.sqrt(n * svv - sv * sv)
    return F.try_divide(top, low)


def statistics(long: DataFrame, k: int, p: float = 2.0) -> DataFrame:
    """One row a pair (sample_a < sample_b) with the sums from which most metrics follow; n is 4^k."""
    long = long.where(F.col("count") > 0).select("sample", "kmer_id", F.col("count").cast("double").alias("u"))
    own = long.groupBy("sample").agg(F.sum("u").alias("s"), F.sum(F.col("u") * F.col("u")).alias("ss"), F.sum(F.pow("u", F.lit(p))).alias("sp"), F.count("*").cast("double").alias("nz"))
    u, v = F.col("a_u"), F.col("b_u")
    totals = own.select("sample", F.col("s").alias("t"))
    shares = long.join(F.broadcast(totals), "sample").withColumn("f", F.col("u") / F.col("t")).drop("t")
    f, g = F.col("a_f"), F.col("b_f")
    mid = (f + g) / 2
    both = _met(shares, ["u", "f"]).groupBy("sample_a", "sample_b").agg(
        F.count("*").cast("double").alias("tt"), F.sum(u * v).alias("uv"), F.sum(F.least(u, v)).alias("low"), F.sum(F.when(u != v, 1.0).otherwise(0.0)).alias("unequal"),
        F.sum(F.abs(u - v) / (u + v)).alias("canberra"), F.sum(F.pow(F.abs(u - v), F.lit(p)) - F.pow(u, F.lit(p)) - F.pow(v, F.lit(p))).alias("power"),
        F.sum(f * F.ln(f / mid) + g * F.ln(g / mid)).alias("kl"), F.sum(f).alias("fa"), F.sum(g).alias("gb"), F.sum(u * F.log2(u / v)).alias("lr"),
    )
    side = lambda s: own.select(F.col("sample").alias(f"sample_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in ("s", "ss", "sp", "nz")])
    rows = _pairs(own.select("sample")).join(F.broadcast(side("a")), "sample_a").join(F.broadcast(side("b")), "sample_b").join(both, ["sample_a", "sample_b"], "left")
    return rows.na.fill(0.0).withColumn("n", F.lit(float(4**k))).withColumn("p", F.lit(float(p)))


def value(metric: str) -> Column:
    """A metric as a column over ``statistics``."""
    c = F.col
    n, tt = c("n"), c("tt")
    tf, ft = c("nz_a") - tt, c("nz_b") - tt
    ff = n - tt - tf - ft
    differ = tf + ft
    square = c("ss_a") + c("ss_b") - 2 * c("uv")
    city = c("s_a") + c("s_b") - 2 * c("low")
    r = _correlation(n, c("s_a"), c("s_b"), c("ss_a"), c("ss_b"), c("uv"))
    twice = 2 * differ
    return {
        "pearson": lambda: r,
        "correlation": lambda: 1 - r,
        "cosine": lambda: 1 - F.try_divide(c("uv"), F.sqrt(c("ss_a")) * F.sqrt(c("ss_b"))),
        "euclidean": lambda: F.sqrt(square),
        "sqeuclidean": lambda: square,
        "cityblock": lambda: city,
        "minkowski": lambda: F.pow(c("sp_a") + c("sp_b") + c("power"), 1 / c("p")),
        "braycurtis": lambda: F.try_divide(city, c("s_a") + c("s_b")),
        "canberra": lambda: c("canberra") + differ,
        "hamming": lambda: (differ + c("unequal")) / n,
        "matching": lambda: differ / n,
        "jaccard": lambda: F.try_divide(differ, tt + differ),
        "jaccard_counts": lambda: F.try_divide(differ + c("unequal"), tt + differ),
        "dice": lambda: F.try_divide(differ, 2 * tt + differ),
        "jensenshannon": lambda: F.sqrt(F.greatest(F.lit(0.0), (c("kl") + (1 - c("fa") + 1 - c("gb")) * F.ln(F.lit(2.0))) / 2)),
        "kulsinski": lambda: (differ - tt + n) / (differ + n),
        "rogerstanimoto": lambda: twice / (tt + ff + twice),
        "russellrao": lambda: (n - tt) / n,
        "sokalmichener": lambda: twice / (tt + ff + twice),
        "sokalsneath": lambda: F.try_divide(twice, tt + twice),
        "yule": lambda: F.when(tf * ft == 0, F.lit(0.0)).otherwise(F.try_divide(2 * tf * ft, tt * ff + tf * ft)),
        "d2": lambda: c("uv"),
        "matching_share": lambda: (ff + tt - c("unequal")) / n,
        "likelihood_ratio": lambda: 2 * c("lr"),
    }[metric]()


def spearman(long: DataFrame, k: int) -> DataFrame:
    """Rank correlation with averaged ties.

    Absent k-mers share one rank; ranks are taken relative to it, so absent
    k-mers are zeros again and sums over held k-mers suffice.
    """
    long = long.where(F.col("count") > 0)
    ties = long.groupBy("sample", "count").agg(F.count("*").alias("t"))
    below = F.sum("t").over(Window.partitionBy("sample").orderBy("count"))
    of_sample = long.groupBy("sample").agg(F.count("*").alias("nz"))
    zeros = F.lit(4**k) - F.col("nz")
    ranked = ties.withColumn("upto", below).join(F.broadcast(of_sample), "sample")
    rank = zeros + F.col("upto") - (F.col("t") - 1) / 2.0
    shifted = ranked.select("sample", "count", (rank - F.when(zeros > 0, (zeros + 1) / 2.0).otherwise(0.0)).alias("u"))
    rows = long.join(shifted, ["sample", "count"]).select("sample", "kmer_id", "u")
    own = rows.groupBy("sample").agg(F.sum("u").alias("s"), F.sum(F.col("u") * F.col("u")).alias("ss"))
    both = _met(rows, ["u"]).groupBy("sample_a", "sample_b").agg(F.sum(F.col("a_u") * F.col("b_u")).alias("uv"))
    side = lambda s: own.select(F.col("sample").alias(f"sample_{s}"), F.col("s").alias(f"s_{s}"), F.col("ss").alias(f"ss_{s}"))
    pairs = _pairs(own.select("sample")).join(F.broadcast(side("a")), "sample_a").join(F.broadcast(side("b")), "sample_b").join(both, ["sample_a", "sample_b"], "left").na.fill(0.0)
    r = _correlation(F.lit(float(4**k)), F.col("s_a"), F.col("s_b"), F.col("ss_a"), F.col("ss_b"), F.col("uv"))
    return pairs.select("sample_a", "sample_b", r.alias("value"))


def filled(long: DataFrame) -> DataFrame:
    """Every observed k-mer for every sample, zeros where a sample lacks it."""
    samples = long.select("sample").distinct()
    return long.select("kmer_id").distinct().crossJoin(F.broadcast(samples)).join(long, ["kmer_id", "sample"], "left").na.fill(0, ["count"])


def chebyshev(long: DataFrame) -> DataFrame:
    met = _met(filled(long).select("sample", "kmer_id", F.col("count").cast("double").alias("u")), ["u"])
    return met.groupBy("sample_a", "sample_b").agg(F.max(F.abs(F.col("a_u") - F.col("b_u"))).alias("value"))


def seuclidean(long: DataFrame) -> DataFrame:
    """Euclidean with each k-mer divided by its variance over samples; k-mers that don't vary are left out."""
    full = filled(long).select("sample", "kmer_id", F.col("count").cast("double").alias("u"))
    spread = full.groupBy("kmer_id").agg(F.var_samp("u").alias("var")).where("var > 0")
    scaled = full.join(spread, "kmer_id").select("sample", "kmer_id", (F.col("u") / F.sqrt("var")).alias("u"))
    d = F.col("a_u") - F.col("b_u")
    return _met(scaled, ["u"]).groupBy("sample_a", "sample_b").agg(F.sqrt(F.sum(d * d)).alias("value"))


def emd(long: DataFrame) -> DataFrame:
    """One-dimensional earth mover's distance between count distributions along the k-mer ids.

    It is the area between the cumulative shares, which change at observed ids only.
    """
    full = filled(long)
    totals = full.groupBy("sample").agg(F.sum("count").alias("t"))
    w = Window.partitionBy("sample").orderBy("kmer_id")
    run = full.join(F.broadcast(totals), "sample").select(
        "sample", "kmer_id", (F.sum("count").over(w) / F.col("t")).alias("u"), F.coalesce(F.lead("kmer_id").over(w) - F.col("kmer_id"), F.lit(0)).cast("double").alias("gap")
    )
    met = _met(run, ["u", "gap"])
    return met.groupBy("sample_a", "sample_b").agg(F.sum(F.abs(F.col("a_u") - F.col("b_u")) * F.col("a_gap")).alias("value"))


def pairwise(long: DataFrame, metric: str, k: int, p: float = 2.0) -> DataFrame:
    """Rows (sample_a, sample_b, value) for sample_a < sample_b over long rows (sample, kmer_id, count)."""
    special = {"spearman": lambda: spearman(long, k), "chebyshev": lambda: chebyshev(long), "seuclidean": lambda: seuclidean(long), "emd": lambda: emd(long)}
    if metric in special:
        return special[metric]()
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}")
    return statistics(long, k, p).select("sample_a", "sample_b", value(metric).alias("value"))


def square(pairs: DataFrame, metric: str) -> DataFrame:
    """Both orders of each pair and the diagonal: 1 for similarities, 0 for distances."""
    turned = pairs.select(F.col("sample_b").alias("sample_a"), F.col("sample_a").alias("sample_b"), "value")
    names = pairs.select("sample_a").union(pairs.select("sample_b")).distinct()
    one = 1.0 if metric in ("pearson", "spearman") else 0.0
    return pairs.unionByName(turned).unionByName(names.select("sample_a", F.col("sample_a").alias("sample_b"), F.lit(one).alias("value")))
