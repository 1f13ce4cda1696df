"""The corpus pipeline: filter, near-dedup, decontaminate, redact, and encode ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all
that the stage before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandlake.llm import common, decontaminate, piece_coding, quality, registry, secret_scan, simhash_dedup


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, common.read_table(spark, sf_dir, "labels"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the least doc_id."""
    return simhash_dedup.keep_one_per_group(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_contaminated(docs, common.read_table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking secrets are masked inside the texts; every document stays."""
    return secret_scan.redact(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document the digests of its piece ids and of what they decode to."""
    return piece_coding.code_report(docs, registry.tokenizer_file("piece_bpe_32k.model"))


STAGES = [
    ("quality_classifier", quality_stage),
    ("simhash_dedup", dedup_stage),
    ("decontamination", decontaminate_stage),
    ("secret_scans", secrets_stage),
    ("piece_coding", encode_stage),
]

#: The stages use hashes and models that SQL can't express; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each one's rows are written as Parquet and read again."""
    docs = common.read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = common.shared_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
