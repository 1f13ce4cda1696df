import random

import pytest
from strandlake import cli


def write(path, name, seed):
    random.seed(seed)
    (path / name).write_text("".join(f">r{i}\n{''.join(random.choice('ACGT') for _ in range(200))}\n" for i in range(3)))
    return str(path / name)


def test_files_to_distances(spark, tmp_path):
    run = lambda *a: cli.main([str(x) for x in a], spark)
    stores = []
    for s in range(3):
        stores.append(tmp_path / f"p{s}")
        run("profile", write(tmp_path, f"f{s}.fa", s), "-k", 3, "-o", stores[-1])
    run("distance", *stores, "--metric", "pearson", "-o", tmp_path / "d")
    assert spark.read.parquet(str(tmp_path / "d")).count() == 9
    run("matrix", *stores, "--method", "DESeq2", "--with-index", "-o", tmp_path / "m.tsv")
    run("distance", tmp_path / "m.tsv", "--index", "kmer_id", "-k", 3, "--metric", "euclidean", "-o", tmp_path / "d2")
    assert spark.read.parquet(str(tmp_path / "d2")).where("sample_a = 'f0'").count() == 3
    run("matrix", *stores, "--method", "PCA", "--n", 2, "-o", tmp_path / "pca")
    run("kmeans", *stores, "--n", 2, "-o", tmp_path / "km")
    run("hierarchical", *stores, "-o", tmp_path / "h")
    assert [spark.read.parquet(str(tmp_path / x)).count() for x in ("pca", "km", "h")] == [6, 3, 2]
    run("view", stores[0], "--re-sort", "--no-singletons", "-o", tmp_path / "v")
    run("shuf", stores[0], "-o", tmp_path / "s")
    run("header", stores[0], "-o", tmp_path / "hd")
    assert spark.read.parquet(str(tmp_path / "s")).count() == 32 and '"total_kmers":594' in spark.read.parquet(str(tmp_path / "hd")).first().header


def test_sequences_to_tables(spark, tmp_path):
    run = lambda *a: cli.main([str(x) for x in a], spark)
    fa = write(tmp_path, "x.fa", 9)
    run("graph", fa, "-k", 4, "--weighted", "-o", tmp_path / "g")
    run("minimizers", fa, "-k", 4, "--window-size", 5, "--only", "-o", tmp_path / "mi")
    run("seeds", fa, fa, "-k", 6, "--window-size", 5, "-o", tmp_path / "se")
    run("codons", fa, "--ignore-invalid-cds", "--include-noncanonicals", "-o", tmp_path / "c")
    assert spark.read.parquet(str(tmp_path / "se")).where("query_id = reference_id").count() == 3
    assert spark.read.parquet(str(tmp_path / "c")).columns[0] == "seq_id"
    with pytest.raises(SystemExit):
        run("distance", fa, "--metric", "unheard", "-o", "x")
