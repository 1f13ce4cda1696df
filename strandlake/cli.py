"""Command line: ``python -m strandlake.cli <command> ...``. Each command reads files and writes one table."""

from __future__ import annotations

import argparse
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators import codons, distance, graph, matrix, minimizers, ml, shred
from strandlake.operators import profile as pf
from strandlake.sources import sequences as sq
from strandlake.sources import tables as tb

VERSION = "0.1.0"


def _inputs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Sequences of the files; a .txt or .tsv input is a sheet of paths."""
    files = []
    for p in paths:
        files += sq.read_samplesheet(spark, p) if p.endswith((".txt", ".tsv")) else [p]
    return sq.read_sequences(spark, files)


def _write(rows: DataFrame, out: str, sep: str = "\t") -> None:
    """Parquet by default; a .tsv or .csv name gives delimited text with a header."""
    if out.endswith((".tsv", ".csv")):
        tb.write_matrix(rows, out, "," if out.endswith(".csv") else sep)
    else:
        rows.write.mode("overwrite").parquet(out)


def _long(spark: SparkSession, args) -> tuple[DataFrame, int]:
    """Long rows (sample, kmer_id, count) of stored profiles or of one delimited matrix, and k."""
    if len(args.inputs) == 1 and args.inputs[0].endswith((".tsv", ".csv")):
        rows = tb.read_matrix(spark, args.inputs[0], args.delimiter, args.index)
        return rows.select("sample", F.col("row_id").cast("long").alias("kmer_id"), F.col("count")), args.k
    parts, ks = [], set()
    for p in args.inputs:
        head = tb.read_header(spark, p).select("k", "name").distinct().collect()
        ks |= {r.k for r in head}
        parts += [(r.name, tb.read_profile(spark, p, r.k, r.name)) for r in head]
    if len(ks) != 1:
        raise SystemExit("all profiles need the same k")
    return matrix.collate(parts), ks.pop()


def cmd_profile(spark, a):
    seqs = _inputs(spark, a.inputs).drop("file").cache()
    ks = range(a.min_k, a.max_k + 1) if a.min_k and a.max_k else [a.k]
    fold = not a.do_not_canonicalize
    for k in ks:
        p = shred.profile_fast(seqs, k, fold) if a.no_ambiguous else shred.profile(seqs, k, "expand", fold)
        p = pf.with_frequency(p).cache()
        name = a.name or PurePosixPath(a.inputs[0]).name.split(".")[0]
        tb.write_profile(p, pf.header(p, pf.file_stats(seqs, k, fold), k, fold), a.out, k, name)
        p.unpersist()


def cmd_view(spark, a):
    p = tb.read_profile(spark, a.inputs[0], a.k or None)
    _write(pf.view(p, "count" if a.re_sort else "id", 2 if a.no_singletons else 0).select("kmer_id", "count", "frequency"), a.out)


def cmd_header(spark, a):
    _write(pf.header_json(tb.read_header(spark, a.inputs[0])), a.out)


def cmd_graph(spark, a):
    seqs = _inputs(spark, a.inputs)
    fold = not a.do_not_canonicalize
    rows = graph.weighted_edges(seqs, a.k, fold=fold) if a.weighted else graph.indexed_edges(seqs, a.k, fold=fold)
    _write(rows, a.out)


def cmd_minimizers(spark, a):
    make = minimizers.window_minimizers if a.true_minimizers else minimizers.stride_minimizers
    tb.write_minimizers(make(_inputs(spark, a.inputs), a.k, a.window_size), a.out, everything=not a.only)


def cmd_seeds(spark, a):
    _write(minimizers.seed_matches(_inputs(spark, [a.inputs[0]]), _inputs(spark, [a.inputs[1]]), a.k, a.window_size), a.out)


def _codon_rows(spark, a, path: str) -> DataFrame:
    seqs = codons.coding(_inputs(spark, [path]), a.ignore_invalid_cds, a.include_noncanonicals)
    return codons.counts(seqs, a.include_start_codons, a.include_stop_codons)


def cmd_codons(spark, a):
    rows = _codon_rows(spark, a, a.inputs[0])
    rows = codons.frequencies(rows) if a.as_frequencies else rows
    _write(codons.table(rows, "freq_len" if a.as_frequencies else "count", stops=not a.no_stop_codons_in_table), a.out)


def cmd_cub(spark, a):
    _write(codons.usage_bias(_codon_rows(spark, a, a.inputs[0]), _codon_rows(spark, a, a.inputs[1])), a.out)


def cmd_matrix(spark, a):
    long, k = _long(spark, a)
    if a.method == "PCA":
        return _write(ml.pca(long, a.n) if a.n else ml.explained_variance(long), a.out)
    if a.method == "tSNE":
        return _write(ml.tsne(long, k, a.n or 2, a.perplexity), a.out)
    value = "count"
    if a.method == "DESeq2":
        long, value = matrix.normalise(long, whole=not a.no_normalized_ints), "normalised"
    elif a.method == "Frequency":
        long, value = matrix.frequencies(long), "frequency"
    names = sorted(r[0] for r in long.select("sample").distinct().collect())
    wide = matrix.wide(long, names, value)
    if a.column_names:
        wide = matrix.rename(wide, tb.read_names(spark, a.column_names))
    return _write(wide.orderBy("kmer_id") if a.with_index else wide.orderBy("kmer_id").drop("kmer_id"), a.out)


def cmd_distance(spark, a):
    long, k = _long(spark, a)
    _write(distance.square(distance.pairwise(long, a.metric, k), a.metric), a.out)


def cmd_kmeans(spark, a):
    long, k = _long(spark, a)
    vectors = ml.sample_vectors(long, k)
    _write(ml.kmeans_elbow(vectors, a.n) if a.elbow else ml.kmeans(vectors, a.n, a.distance), a.out)


def cmd_hierarchical(spark, a):
    long, k = _long(spark, a)
    _write(ml.linkage(distance.pairwise(long, a.metric, k), a.method), a.out)


def cmd_shuf(spark, a):
    _write(pf.shuffle(tb.read_profile(spark, a.inputs[0], a.k or None), a.seed), a.out)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strandlake", description=__doc__)
    top.add_argument("--version", action="version", version=VERSION)
    sub = top.add_subparsers(dest="command", required=True)

    def add(command, run, k=None, **flags):
        p = sub.add_parser(command)
        p.add_argument("inputs", nargs="+")
        p.add_argument("-o", "--out", required=True)
        p.add_argument("-k", type=int, default=k or 0)
        for flag, default in flags.items():
            option = "--" + flag.replace("_", "-")
            if default is False:
                p.add_argument(option, action="store_true")
            else:
                p.add_argument(option, type=type(default) if default is not None else str, default=default)
        p.set_defaults(run=run)
        return p

    add("profile", cmd_profile, 12, min_k=0, max_k=0, name=None, no_ambiguous=False, do_not_canonicalize=False)
    add("view", cmd_view, re_sort=False, no_singletons=False)
    add("header", cmd_header)
    add("graph", cmd_graph, 12, weighted=False, do_not_canonicalize=False)
    add("minimizers", cmd_minimizers, 12, window_size=10, true_minimizers=False, only=False)
    add("seeds", cmd_seeds, 12, window_size=10)
    coding = dict(ignore_invalid_cds=False, include_noncanonicals=False, include_start_codons=False, include_stop_codons=False)
    add("codons", cmd_codons, as_frequencies=False, no_stop_codons_in_table=False, **coding)
    add("CUB", cmd_cub, **coding)
    table = dict(delimiter="\t", index=None)
    add("matrix", cmd_matrix, n=0, perplexity=5.0, no_normalized_ints=False, with_index=False, column_names=None, **table).add_argument("--method", choices=["from", "DESeq2", "Frequency", "PCA", "tSNE"], default="from")
    add("distance", cmd_distance, **table).add_argument("--metric", choices=distance.METRICS, required=True)
    add("kmeans", cmd_kmeans, n=2, distance="e", elbow=False, **table)
    add("hierarchical", cmd_hierarchical, metric="euclidean", **table).add_argument("-m", "--method", choices=ml.LINKAGES, default="ward")
    add("shuf", cmd_shuf, seed=42)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    args.run(spark or SparkSession.builder.appName("strandlake").getOrCreate(), args)


if __name__ == "__main__":
    main()
