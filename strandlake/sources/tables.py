"""Matrices as TSV, and profiles, edge lists and minimizer lists as tables or as text files with a header."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the text format: the line between header and body.
DELIMITER = "=" * 24


def read_matrix(spark: SparkSession, path: str, sep: str = "\t", index: str | None = None) -> DataFrame:
    """Long rows (row_id, sample, count double) of a delimited matrix with a header line.

    ``index`` names the column of row ids; without it they rise in file order, with gaps between a file's blocks.
    """
    wide = spark.read.option("sep", sep).option("header", True).option("inferSchema", True).csv(path)
    if index is None:
        wide, index = wide.withColumn("row_id", F.monotonically_increasing_id()), "row_id"
    samples = [c for c in wide.columns if c != index]
    pairs = F.array(*[F.struct(F.lit(c).alias("sample"), F.col(f"`{c}`").cast("double").alias("count")) for c in samples])
    return wide.select(F.col(f"`{index}`").alias("row_id"), F.explode(pairs).alias("p")).select("row_id", "p.sample", "p.count")


def write_matrix(wide: DataFrame, path: str, sep: str = "\t") -> None:
    wide.write.mode("overwrite").option("sep", sep).option("header", True).csv(path)


def read_names(spark: SparkSession, path: str) -> list[str]:
    """Column names: one TSV line, or one a line."""
    lines = [r.value for r in spark.read.text(path).toLocalIterator() if r.value.strip()]
    return lines[0].split("\t") if len(lines) == 1 else [x.strip() for x in lines]


def write_profile(profile: DataFrame, header: DataFrame, path: str, k: int, name: str) -> None:
    """A profile under ``path``/profiles/k=../name=.., sorted by id inside files, and its header beside it."""
    body = profile.repartitionByRange("kmer_id").sortWithinPartitions("kmer_id")
    body.write.mode("overwrite").parquet(f"{path}/profiles/k={k}/name={name}")
    header.write.mode("overwrite").parquet(f"{path}/headers/k={k}/name={name}")


def read_profile(spark: SparkSession, path: str, k: int | None = None, name: str | None = None) -> DataFrame:
    """Stored profiles with columns k and name; partition pruning reads those asked for only."""
    rows = spark.read.parquet(f"{path}/profiles")
    if k is not None:
        rows = rows.where(F.col("k") == k)
    return rows if name is None else rows.where(F.col("name") == name)


def read_header(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/headers")


def export_profile(indexed: DataFrame, header: dict, path: str) -> None:
    """Gzip text: a JSON header, the delimiter, then rows (idx, kmer_id, count, frequency) in order of idx."""
    spark = indexed.sparkSession
    top = [*json.dumps(header, indent=1, sort_keys=True).split("\n"), DELIMITER]
    spark.createDataFrame([(i, x) for i, x in enumerate(top)], "i long, value string").coalesce(1).sortWithinPartitions("i").select("value").write.mode("overwrite").option("compression", "gzip").text(f"{path}/header")
    rows = indexed.repartitionByRange("idx").sortWithinPartitions("idx")
    rows.select(F.concat_ws("\t", "idx", "kmer_id", "count", "frequency").alias("value")).write.mode("overwrite").option("compression", "gzip").text(f"{path}/body")


def import_profile(spark: SparkSession, path: str) -> DataFrame:
    """Rows (kmer_id, count) of text files in that format: body lines are four tab-separated numbers, the rest is header.

    Block-gzip files with a .gz name are read by the gzip codec. Frequencies are
    made anew from counts, for stored ones may be rounded.
    """
    parts = F.split("value", "\t")
    body = spark.read.text(path).where(F.col("value").rlike(r"^\d+\t\d+\t\d+\t[0-9.eE+-]+$"))
    return body.select(parts[1].cast("bigint").alias("kmer_id"), parts[2].cast("bigint").alias("count"))


def write_edges(edges: DataFrame, path: str) -> None:
    edges.write.mode("overwrite").parquet(path)


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_minimizers(rows: DataFrame, path: str, everything: bool = False) -> None:
    """TSV (seq_id, pos, kmer_id, is_min): minimizers only, or all positions; samples are folders of their own."""
    kept = rows if everything else rows.where("is_min = 1")
    own = ["sample"] if "sample" in rows.columns else []
    kept.select("seq_id", "pos", "kmer_id", "is_min", *own).write.mode("overwrite").partitionBy(*own).option("sep", "\t").csv(path)


def read_minimizers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", "\t").schema("seq_id string, pos int, kmer_id long, is_min int").csv(path)
