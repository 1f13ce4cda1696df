"""Sample matrices: collation, frequencies, median-of-ratios normalisation, renaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.operators import profile as pf


def collate(profiles: list[tuple[str, DataFrame]]) -> DataFrame:
    """Long rows (sample, kmer_id, count) of named profiles."""
    out = None
    for name, p in profiles:
        rows = p.select(F.lit(name).alias("sample"), "kmer_id", "count")
        out = rows if out is None else out.unionByName(rows)
    return out


def wide(long: DataFrame, samples: list[str], value: str = "count", dense_k: int | None = None, fold: bool = True) -> DataFrame:
    """One row a k-mer, one column a sample, zeros where a sample lacks it; ``dense_k`` adds k-mers that all lack."""
    table = long.groupBy("kmer_id").pivot("sample", samples).agg(F.sum(value)).na.fill(0)
    if dense_k is None:
        return table
    return pf.universe(long.sparkSession, dense_k, fold).join(table, "kmer_id", "left").na.fill(0)


def rename(table: DataFrame, names: list[str]) -> DataFrame:
    """New names for the sample columns, in order."""
    if len(names) != len(table.columns) - 1:
        raise ValueError("one name a sample column is needed")
    return table.toDF(table.columns[0], *names)


def frequencies(long: DataFrame) -> DataFrame:
    return pf.with_frequency(long, ("sample",))


def size_factors(long: DataFrame) -> DataFrame:
    """Rows (sample, size_factor): median over k-mers that all samples hold of count over geometric mean."""
    n = long.select("sample").distinct().agg(F.count("*").alias("n_samples"))
    means = long.where(F.col("count") > 0).groupBy("kmer_id").agg(F.avg(F.ln("count")).alias("log_mean"), F.count("*").alias("n"))
    shared = means.join(F.broadcast(n), means["n"] == n["n_samples"]).select("kmer_id", "log_mean")
    ratio = long.join(shared, "kmer_id").withColumn("ratio", F.col("count") / F.exp("log_mean"))
    return ratio.groupBy("sample").agg(F.percentile("ratio", F.lit(0.5)).alias("size_factor"))


def normalise(long: DataFrame, whole: bool = True) -> DataFrame:
    """Counts divided by their sample's size factor, rounded half to even unless ``whole`` is false."""
    factors = size_factors(long)
    value = F.col("count") / F.col("size_factor")
    return long.join(F.broadcast(factors), "sample").select("sample", "kmer_id", (F.rint(value).cast("bigint") if whole else value).alias("normalised"))
