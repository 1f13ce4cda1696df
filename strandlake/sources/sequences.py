"""FASTA, FASTQ and sample-sheet readers, file checks, and sequences out of text tables."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import kmers as fn

# File name endings.
FASTA_ENDS = (".fa", ".fna", ".fasta")
FASTQ_ENDS = (".fq", ".fastq")


def file_kind(path: str) -> str:
    """'fasta', 'fastq' or 'other' by ending, with or without .gz."""
    name = path.lower().removesuffix(".gz")
    return "fasta" if name.endswith(FASTA_ENDS) else "fastq" if name.endswith(FASTQ_ENDS) else "other"


def is_gzip(spark: SparkSession, path: str) -> bool:
    """True if the file starts with gzip's two magic bytes; only those are read."""
    jvm = spark.sparkContext._jvm
    file = jvm.org.apache.hadoop.fs.Path(path)
    stream = file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(file)
    try:
        return (stream.read(), stream.read()) == (0x1F, 0x8B)
    finally:
        stream.close()


def checksums(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Rows (path, md5, sha256, n_bytes) of whole files."""
    files = spark.read.format("binaryFile").load(paths)
    return files.select("path", F.md5("content").alias("md5"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("n_bytes"))


def read_fasta(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Rows (sample, seq_id, seq, file). A record runs to the next line that starts with '>'.

    The id is the header's first word, the sample the file's name up to its
    first dot. Sequences are upper-cased; text before the first record is left out.
    """
    raw = spark.read.option("lineSep", "\n>").text(paths).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))
    record = F.regexp_replace(F.col("value"), r"^>", "")
    head = F.regexp_extract(record, r"^([^\n]*)", 1)
    body = F.regexp_replace(F.regexp_replace(record, r"^[^\n]*", ""), r"\s", "")
    rows = raw.select(F.regexp_extract(head, r"^\s*(\S+)", 1).alias("seq_id"), F.upper(body).alias("seq"), "file")
    return rows.where(F.length("seq_id") > 0).select(fn.sample_name(F.col("file")).alias("sample"), "seq_id", "seq", "file")


def _first_record(lines: list[str]) -> int:
    """Place of the first line that starts a record: it starts with '@' and the line after next with '+'; -1 if none is seen.

    No sequence starts with either, so a quality line that starts with '@' is not taken for a header.
    """
    return next((i for i in range(len(lines) - 2) if lines[i][:1] == "@" and lines[i + 2][:1] == "+"), -1)


def read_fastq(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Rows (sample, seq_id, seq, qual, file) of four-line records.

    A file is read in blocks by many tasks. Each finds the first record that
    starts in its block; the few lines before it and after the last whole record
    are put together over the blocks of the file. An incomplete record at the
    end of a file is left out.
    """
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    names = ["file", "block", "seq_id", "seq", "qual", "rest"]

    def records(rows: list[str]) -> list[list[str]]:
        heads = [(h[1:].split() or [""])[0] for h in rows[0::4]]
        return [heads, [x.strip().upper() for x in rows[1::4]], [x.rstrip("\r") for x in rows[3::4]]]

    def batch(file: str, block: int, rows: list[str], rest: list[str] | None):
        ids, seqs, quals = records(rows) if rest is None else ([None], [None], [None])
        n = len(ids)
        return pa.RecordBatch.from_arrays([pa.array([file] * n), pa.array([block] * n, pa.int64()), pa.array(ids, pa.string()), pa.array(seqs, pa.string()), pa.array(quals, pa.string()), pa.array([rest] * n, pa.list_(pa.string()))], names)

    def run(batches):
        at, held, started, early = None, [], False, []

        def ended():
            """What a block leaves over: lines before its first record, then those after its last whole one."""
            if at is not None and early + held:
                yield batch(*at, [], early + held)

        for b in batches:
            files, blocks, values = (b.column(i).to_pylist() for i in range(3))
            k = 0
            while k < len(values):
                stop = k
                while stop < len(values) and (files[stop], blocks[stop]) == (files[k], blocks[k]):
                    stop += 1
                if (files[k], blocks[k]) != at:
                    yield from ended()
                    at, held, early = (files[k], blocks[k]), [], []
                    started = blocks[k] == 0
                held += values[k:stop]
                k = stop
                if not started and (first := _first_record(held)) >= 0:
                    early, held, started = held[:first], held[first:], True
                if started and len(held) >= 4:
                    whole = len(held) // 4 * 4
                    yield batch(*at, held[:whole], None)
                    held = held[whole:]
        yield from ended()

    found = lines.mapInArrow(run, "file string, block long, seq_id string, seq string, qual string, rest array<string>")
    left = found.where(F.col("rest").isNotNull()).groupBy("file").agg(F.sort_array(F.collect_list(F.struct("block", "rest"))).alias("parts"))
    text = F.flatten("parts.rest")
    of_border = left.select("file", text.alias("l")).select("file", "l", F.explode(F.when(F.size("l") >= 4, F.sequence(F.lit(0), F.floor(F.size("l") / 4).cast("int") - 1))).alias("i"))
    line = lambda j: F.col("l")[F.col("i") * 4 + j]
    borders = of_border.select("file", F.regexp_extract(line(0), r"^@\s*(\S*)", 1).alias("seq_id"), F.upper(F.trim(line(1))).alias("seq"), line(3).alias("qual"))
    rows = found.where(F.col("rest").isNull()).select("file", "seq_id", "seq", "qual").unionByName(borders)
    return rows.select(fn.sample_name(F.col("file")).alias("sample"), "seq_id", "seq", "qual", "file")


def read_sequences(spark: SparkSession, paths: str | Iterable[str]) -> DataFrame:
    """Rows (sample, seq_id, seq, file) of FASTA and FASTQ files together; other endings are an error."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    kinds: dict[str, list[str]] = {}
    for p in paths:
        kinds.setdefault(file_kind(p), []).append(p)
    if "other" in kinds:
        raise ValueError(f"neither FASTA nor FASTQ: {kinds['other']}")
    parts = []
    if "fasta" in kinds:
        parts.append(read_fasta(spark, kinds["fasta"]))
    if "fastq" in kinds:
        parts.append(read_fastq(spark, kinds["fastq"]).drop("qual"))
    if not parts:
        raise ValueError("no input files")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_samplesheet(spark: SparkSession, path: str) -> list[str]:
    """File paths listed one a line (first column of a TSV); blank lines are left out. Sheets are small."""
    lines = spark.read.text(path).select(F.trim(F.split("value", "\t")[0]).alias("p")).where("p <> ''")
    return [r.p for r in lines.toLocalIterator()]


def from_documents(documents: DataFrame, alphabet: str = "ACGT") -> DataFrame:
    """Sequences (sample, seq_id, seq) made of the letters of ``alphabet`` in each document's text."""
    return documents.select(F.col("source").alias("sample"), F.col("doc_id").alias("seq_id"), fn.clean(F.col("text"), alphabet).alias("seq"))
