"""Queries of the training-data operators, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandlake.llm import (
    chat_format,
    decontaminate,
    html_extract,
    piece_coding,
    quality,
    secret_scan,
    simhash_dedup,
    token_frames,
    toxicity,
    vector_search,
)
from strandlake.llm.common import read_table


def tokenizer_file(name: str) -> str:
    """Path of an installed public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page; null html gives '', repeated rows repeat, an empty table gives no rows."""
    return html_extract.extract(read_table(spark, sf_dir, "pages"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document; null and empty texts score by the constant, null ids are not held out."""
    return toxicity.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that match; null and empty texts match nothing."""
    return decontaminate.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every document; null and empty texts score by zero statistics, null ids are not held out."""
    return quality.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every formatted conversation and of the probe; null texts are empty, null ids one conversation."""
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    return chat_format.digest_rows(chat_format.format_rows(rows.unionByName(probe), tokenizer_file("byte_bpe_50k.json")))


def op6_piece_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the N best segmentations of every document; a null text is empty, which is one space piece."""
    return piece_coding.code_report(read_table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document; null texts have the zero fingerprint, null ids the group of their fingerprint."""
    return simhash_dedup.simhash_components(read_table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document with verdicts by ownership; null texts hold none."""
    return secret_scan.scan(read_table(spark, sf_dir, "documents"))


def op9_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors of every twentieth one; unusable vectors take no part."""
    return vector_search.search(read_table(spark, sf_dir, "embeddings"))


def op10_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start, size and checksum of every document's ids, read back from frame files; null texts hold the end id only."""
    return token_frames.token_files(read_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


QUERIES = {
    f.__name__: f for f in (
        op1_html_extract, op2_toxicity, op3_decontaminate, op4_quality, op5_chat_format,
        op6_piece_coding, op7_simhash, op8_secret_scan, op9_vector_search, op10_token_frames,
    )
}
#: op5: what the template must give back, from the input rows alone. Control strings and backslashes cost one character more.
_OP5 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), m AS (
  SELECT *, length(text) + length(role)
    + list_sum(list_transform(['\', '<s>', '</s>', '[INST]', '[/INST]'], lambda c:
        (length(text) - length(replace(text, c, ''))) // length(c) + (length(role) - length(replace(role, c, ''))) // length(c)))
    + length('<s>[INST][/INST]</s>') AS chars
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM m GROUP BY conv_id
"""

ORACLES: dict[str, str] = {"op5_chat_format": _OP5}
