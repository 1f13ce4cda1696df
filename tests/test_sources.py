import random
import gzip
import hashlib

import pytest
from strandlake.operators import profile as pf
from strandlake.operators import shred
from strandlake.sources import sequences as sq
from strandlake.sources import tables as tb


def test_fasta(spark, tmp_path):
    p = tmp_path / "one.x.fa"
    p.write_text(">s1 desc\nACGT\nAAC\n>s2\nGGG\nTT\n>s3 nothing\n>s4\nacgtn\n")
    got = sorted((r["sample"], r.seq_id, r.seq) for r in sq.read_fasta(spark, str(p)).collect())
    assert got == [("one", "s1", "ACGTAAC"), ("one", "s2", "GGGTT"), ("one", "s3", ""), ("one", "s4", "ACGTN")]


def test_gzip_fasta_and_fastq_together(spark, tmp_path):
    with gzip.open(tmp_path / "z.fna.gz", "wt") as f:
        f.write(">r1\nAC\nGT\n")
    (tmp_path / "y.fq").write_text("@q1 x\nACGT\n+\nIIII\n@q2\nGG\n+q2\n@>\n")
    paths = [str(tmp_path / "z.fna.gz"), str(tmp_path / "y.fq")]
    assert sorted((r["sample"], r.seq_id, r.seq) for r in sq.read_sequences(spark, paths).collect()) == [("y", "q1", "ACGT"), ("y", "q2", "GG"), ("z", "r1", "ACGT")]
    assert [r.qual for r in sq.read_fastq(spark, paths[1]).orderBy("seq_id").collect()] == ["IIII", "@>"]
    assert sq.is_gzip(spark, paths[0]) and not sq.is_gzip(spark, paths[1])
    with pytest.raises(ValueError):
        sq.read_sequences(spark, ["x.bam"])


def test_kinds_sheets_and_sums(spark, tmp_path):
    assert [sq.file_kind(x) for x in ("a.FA", "b.fasta.gz", "c.fastq", "d.fq.gz", "e.txt")] == ["fasta", "fasta", "fastq", "fastq", "other"]
    sheet = tmp_path / "sheet.tsv"
    sheet.write_text("a.fa\tx\n\nb.fa\n")
    assert sq.read_samplesheet(spark, str(sheet)) == ["a.fa", "b.fa"]
    row = sq.checksums(spark, str(sheet)).first()
    assert row.md5 == hashlib.md5(sheet.read_bytes()).hexdigest() and row.sha256 == hashlib.sha256(sheet.read_bytes()).hexdigest()


def test_profiles_round_trip(spark, tmp_path):
    seqs = spark.createDataFrame([("a", 1, "ACGTACGTTTGACA")], "sample string, seq_id long, seq string")
    p = pf.with_frequency(shred.profile_fast(seqs, 3))
    tb.write_profile(p, pf.header(p, pf.file_stats(seqs, 3), 3), str(tmp_path / "store"), 3, "mine")
    back = tb.read_profile(spark, str(tmp_path / "store"), 3, "mine")
    assert sorted((r.kmer_id, r["count"]) for r in back.collect()) == sorted((r.kmer_id, r["count"]) for r in p.collect())
    assert tb.read_header(spark, str(tmp_path / "store")).first().total_kmers == 12
    tb.export_profile(pf.with_index(p, "kmer_id", []), {"k": 3}, str(tmp_path / "text"))
    read = tb.import_profile(spark, str(tmp_path / "text" / "*"))
    assert sorted(map(tuple, read.collect())) == sorted((r.kmer_id, r["count"]) for r in p.collect())


def test_matrices(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("id\ta\tb\n0\t1\t2\n1\t0\t4\n")
    got = sorted((r.row_id, r["sample"], r["count"]) for r in tb.read_matrix(spark, str(tmp_path / "m.tsv"), index="id").collect())
    assert got == [(0, "a", 1.0), (0, "b", 2.0), (1, "a", 0.0), (1, "b", 4.0)]
    (tmp_path / "names").write_text("x\ty\n")
    assert tb.read_names(spark, str(tmp_path / "names")) == ["x", "y"]


def test_minimizer_lists(spark, tmp_path):
    rows = spark.createDataFrame([("s", 0, 5, 1), ("s", 1, 7, 0)], "seq_id string, pos int, kmer_id long, is_min int")
    tb.write_minimizers(rows, str(tmp_path / "m"))
    assert [tuple(r) for r in tb.read_minimizers(spark, str(tmp_path / "m")).collect()] == [("s", 0, 5, 1)]


def test_fastq_in_many_blocks(spark, tmp_path):
    rng = random.Random(4)
    want = []
    with open(tmp_path / "reads.fastq", "w") as f:
        for i in range(300):
            s = "".join(rng.choice("ACGTN") for _ in range(rng.randint(0, 60)))
            q = "".join(rng.choice("@+I#") for _ in s)
            want.append((f"r{i}", s, q))
            f.write(f"@r{i} read\n{s.lower() if i % 2 else s}\n+{'r' * (i % 3)}\n{q}\n")
        f.write("@last\nACG\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for size in ("100", "333", "5000", "100000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            assert sorted((r.seq_id, r.seq, r.qual) for r in sq.read_fastq(spark, str(tmp_path / "reads.fastq")).collect()) == sorted(want), size
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_edge_list_and_dot(spark, tmp_path):
    from strandlake.operators import graph

    rows = graph.weighted_edges(spark.createDataFrame([("a", 1, "ACGTACGTTTGACA")], "sample string, seq_id long, seq string"), 3)
    tb.write_edges(rows, str(tmp_path / "e"))
    assert sorted(map(tuple, tb.read_edges(spark, str(tmp_path / "e")).collect())) == sorted(map(tuple, rows.collect()))
    graph.to_dot(rows, str(tmp_path / "dot"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "dot")).collect()]
    assert sorted(lines) == sorted(f"  {r.kmer_id1} -> {r.kmer_id2} [weight={r.weight}];" for r in rows.collect())
