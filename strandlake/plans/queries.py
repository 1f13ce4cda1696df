"""The named k-mer queries: each takes (spark, sf_dir) and returns a DataFrame over whole tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake import alphabet as ab
from strandlake.functions import kmers as fn
from strandlake.operators import codons, distance, graph, matrix, minimizers, ml, probability, shred
from strandlake.operators import profile as pf
from strandlake.sources import sequences as sq
from strandlake.sources import tables as tb
from strandlake.sources.sequences import from_documents

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: Parameters of the queries; the SQL for them uses the same.
K_PROFILE, K_SMALL, K_PAIRS, K_EDGES, K_SEEDS, WINDOW = 8, 4, 3, 6, 10, 5
SAMPLES = [f"src{i}" for i in range(20)]
ALPHABETS = {"plain": "ACGT", "n": "ACGTN", "iupac": "ACGTRYSWKMBDHVN"}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def seqs(spark: SparkSession, sf_dir: str, alphabet: str = "plain") -> DataFrame:
    return from_documents(documents(spark, sf_dir), ALPHABETS[alphabet])


def tidy(value: Column | str, digits: int = 6) -> Column:
    """Rounded, with no negative zero."""
    return F.round(F.col(value) if isinstance(value, str) else value, digits) + F.lit(0.0)


def distinct_kmers(spark: SparkSession, sf_dir: str, k: int = K_SMALL) -> DataFrame:
    return shred.word_counts(seqs(spark, sf_dir), k, ab.BASES).select("kmer")


def whole_profile(spark: SparkSession, sf_dir: str, k: int = K_PROFILE, fold: bool = True) -> DataFrame:
    return shred.profile_fast(seqs(spark, sf_dir), k, fold)


def by_sample(spark: SparkSession, sf_dir: str, k: int = K_PAIRS) -> DataFrame:
    return shred.profile_fast(seqs(spark, sf_dir), k, True, ("sample",))


# --- sequences and predicates ---


@query
def seq_clean(spark, sf_dir):
    return seqs(spark, sf_dir)


@query
def seq_stats(spark, sf_dir):
    return pf.file_stats(seqs(spark, sf_dir), K_SMALL)


def _letters(spark, sf_dir) -> DataFrame:
    """The letters A-Z of each text's words, upper-cased, a word a row: sequences of unknown kind."""
    words = F.explode(F.split(F.upper(F.regexp_replace("text", "[^A-Za-z ]", "")), " +"))
    return documents(spark, sf_dir).select(words.alias("seq")).where("seq <> ''").distinct()


@query
def is_na(spark, sf_dir):
    return _letters(spark, sf_dir).select("seq", fn.is_nucleotide(F.col("seq")).alias("is_na"), fn.is_amino(F.col("seq")).alias("is_aa"))


@query
def iupac_symbols(spark, sf_dir):
    s = F.col("seq")
    join = lambda c: F.array_join(F.array_sort(c), "")
    return _letters(spark, sf_dir).select("seq", join(fn.letters(s)).alias("letters"), join(fn.extended_symbols(s)).alias("extended"), join(fn.foreign_symbols(s)).alias("non_iupac"), F.length(s).alias("seq_len"))


@query
def is_cds(spark, sf_dir):
    s = F.col("seq")
    return seqs(spark, sf_dir).select("seq_id", fn.is_cds(s).alias("is_cds"), fn.is_cds(s, True).alias("is_cds_any"))


@query
def revcomp(spark, sf_dir):
    return distinct_kmers(spark, sf_dir).select("kmer", fn.reverse_complement(F.col("kmer")).alias("revcomp"))


@query
def are_neighbors(spark, sf_dir):
    """K-mers two apart against each other and consecutive ones: some neighbours, some not."""
    w = distinct_kmers(spark, sf_dir, K_SMALL + 2)
    a = F.substring("kmer", 1, K_SMALL)
    pairs = w.select(a.alias("kmer1"), F.col("kmer").substr(2, K_SMALL).alias("kmer2")).union(w.select(a.alias("kmer1"), F.col("kmer").substr(3, K_SMALL).alias("kmer2"))).distinct()
    x, y = F.col("kmer1"), F.col("kmer2")
    return pairs.select("kmer1", "kmer2", fn.is_right_neighbour(x, y).alias("is_right"), fn.is_left_neighbour(x, y).alias("is_left"), fn.are_neighbours(x, y).alias("is_neighbor"))


@query
def number_checks(spark, sf_dir):
    tokens = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.explode(F.split(F.regexp_replace("props", "[^A-Za-z0-9.+-]+", " "), " ")).alias("token")).where("token <> ''").distinct()
    return tokens.select("token", fn.is_integer(F.col("token")).alias("is_integer"))


# --- scalar functions ---


@query
def kmer_encode(spark, sf_dir):
    return distinct_kmers(spark, sf_dir).select("kmer", fn.encode(F.col("kmer")).alias("kmer_id"))


@query
def kmer_decode(spark, sf_dir):
    return spark.range(4**K_SMALL).select(F.col("id").alias("kmer_id"), fn.decode(F.col("id"), K_SMALL).alias("kmer"))


@query
def canonical_id(spark, sf_dir):
    return distinct_kmers(spark, sf_dir).select("kmer", fn.canonical(F.col("kmer")).alias("kmer_id"))


def _listed(spark, sf_dir, make) -> DataFrame:
    return distinct_kmers(spark, sf_dir).select("kmer", F.posexplode(make(F.col("kmer"))).alias("n", "neighbor_id"))


@query
def left_neighbors(spark, sf_dir):
    return _listed(spark, sf_dir, fn.left_neighbours)


@query
def right_neighbors(spark, sf_dir):
    return _listed(spark, sf_dir, fn.right_neighbours)


@query
def neighbors(spark, sf_dir):
    return _listed(spark, sf_dir, fn.neighbours)


@query
def iupac_expand(spark, sf_dir):
    rows = shred.word_counts(seqs(spark, sf_dir, "iupac"), 3, ALPHABETS["iupac"]).select("kmer")
    return rows.select("kmer", F.explode(fn.expand(F.col("kmer"))).alias("expansion"))


@query
def codon_translate(spark, sf_dir):
    codon = F.explode(F.array(*map(F.lit, ab.CODONS))).alias("codon")
    return spark.range(1).select(codon).select("codon", fn.encode(F.col("codon")).alias("codon_id"), fn.amino(F.col("codon")).alias("aa"))


@query
def sample_names(spark, sf_dir):
    urls = spark.read.parquet(f"{sf_dir}/pages.parquet").select("url")
    return urls.select("url", fn.sample_name(F.col("url")).alias("sample"))


# --- profiles ---


@query
def kmer_occurrences(spark, sf_dir):
    return shred.occurrences(seqs(spark, sf_dir), K_PROFILE, "drop").select("seq_id", "pos", "kmer", "kmer_id")


@query
def profile_canonical(spark, sf_dir):
    return whole_profile(spark, sf_dir)


@query
def profile_forward(spark, sf_dir):
    return whole_profile(spark, sf_dir, fold=False)


@query
def profile_expressions(spark, sf_dir):
    return shred.profile(seqs(spark, sf_dir), K_EDGES)


@query
def profile_frequency(spark, sf_dir):
    return pf.with_frequency(whole_profile(spark, sf_dir, K_EDGES)).withColumn("frequency", tidy("frequency", 12))


@query
def composite_by_source(spark, sf_dir):
    return by_sample(spark, sf_dir, K_SMALL)


@query
def amino_profile(spark, sf_dir):
    return shred.amino_profile(from_documents(documents(spark, sf_dir), ab.AMINO_ACIDS), 2)


@query
def amino_encode(spark, sf_dir):
    rows = shred.word_counts(from_documents(documents(spark, sf_dir), ab.AMINO_ACIDS), 2, ab.AMINO_ACIDS).select("kmer")
    return rows.select("kmer", fn.encode_amino(F.col("kmer")).alias("kmer_id"))


@query
def multi_k(spark, sf_dir):
    return shred.multi_k(seqs(spark, sf_dir), [4, 5, 6])


@query
def profile_chunked(spark, sf_dir):
    return shred.profile_fast(shred.chunk(seqs(spark, sf_dir), K_PROFILE, 100), K_PROFILE)


@query
def no_ambiguous(spark, sf_dir):
    return shred.profile(seqs(spark, sf_dir, "n"), 3, "drop")


@query
def ambiguous_expand(spark, sf_dir):
    return shred.profile(seqs(spark, sf_dir, "iupac"), 3, "expand")


@query
def nullomers(spark, sf_dir):
    return pf.nullomers(whole_profile(spark, sf_dir), K_PROFILE)


@query
def nullomer_count(spark, sf_dir):
    return pf.totals(whole_profile(spark, sf_dir), K_PROFILE).select("nullomers", "unique_nullomers_compat")


@query
def histogram(spark, sf_dir):
    return pf.histogram(whole_profile(spark, sf_dir))


@query
def coverage_peak(spark, sf_dir):
    return pf.coverage(whole_profile(spark, sf_dir))


@query
def argmax_kmer(spark, sf_dir):
    return pf.argmax(whole_profile(spark, sf_dir), "kmer_id", "count")


@query
def no_singletons(spark, sf_dir):
    return pf.view(whole_profile(spark, sf_dir), min_count=2)


@query
def sort_by_count(spark, sf_dir):
    p = whole_profile(spark, sf_dir, K_SMALL).withColumn("__m", -F.col("count"))
    return pf.with_index(p, "__m", ["kmer_id"]).select("idx", "kmer_id", "count")


@query
def row_number(spark, sf_dir):
    return pf.with_index(pf.with_frequency(whole_profile(spark, sf_dir, K_EDGES)), "kmer_id", []).select("idx", "kmer_id", "count", tidy("frequency", 12).alias("frequency"))


@query
def header_totals(spark, sf_dir):
    return pf.totals(whole_profile(spark, sf_dir), K_PROFILE)


@query
def header_document(spark, sf_dir):
    return pf.header_json(pf.header(whole_profile(spark, sf_dir, K_SMALL), pf.file_stats(seqs(spark, sf_dir), K_SMALL), K_SMALL))


@query
def shuffle(spark, sf_dir):
    return pf.shuffle(whole_profile(spark, sf_dir, K_SMALL))


# --- matrices ---


def all_samples(spark: SparkSession, sf_dir: str) -> list[str]:
    """SAMPLES and whatever other sources the documents have; a null source is named ``null``."""
    found = [r.source for r in documents(spark, sf_dir).select("source").distinct().limit(ml.MAX_SAMPLES + 1).collect()]
    if len(found) > ml.MAX_SAMPLES:
        raise ValueError(f"more than {ml.MAX_SAMPLES} samples")
    if None in found and "null" in found:
        raise ValueError("a source is named null and another is null")
    return [*SAMPLES, *sorted({"null" if s is None else s for s in found} - set(SAMPLES))]


@query
def collate_wide(spark, sf_dir):
    return matrix.wide(by_sample(spark, sf_dir).na.fill("null", ["sample"]), all_samples(spark, sf_dir))


@query
def collate_dense(spark, sf_dir):
    return matrix.wide(by_sample(spark, sf_dir, 5).na.fill("null", ["sample"]), all_samples(spark, sf_dir), dense_k=5)


@query
def renamed_columns(spark, sf_dir):
    table = collate_wide(spark, sf_dir)
    return matrix.rename(table, [f"column_{i}" for i in range(len(table.columns) - 1)])


@query
def frequency_matrix(spark, sf_dir):
    return matrix.frequencies(by_sample(spark, sf_dir)).select("sample", "kmer_id", tidy("frequency", 9).alias("frequency"))


@query
def size_factors(spark, sf_dir):
    return matrix.size_factors(by_sample(spark, sf_dir)).select("sample", tidy("size_factor", 9).alias("size_factor"))


@query
def normalized(spark, sf_dir):
    return matrix.normalise(by_sample(spark, sf_dir), whole=False).select("sample", "kmer_id", tidy("normalised").alias("normalized"))


# --- distances: one query a metric ---


def _distance(metric: str) -> Query:
    def run(spark, sf_dir):
        k = K_SMALL if metric in ("chebyshev", "seuclidean", "emd") else K_PAIRS
        long = by_sample(spark, sf_dir, k)
        return distance.pairwise(long, metric, k).select("sample_a", "sample_b", tidy("value").alias("value"))

    run.__name__ = f"distance_{metric}"
    return run


for _metric in distance.METRICS:
    query(_distance(_metric))


@query
def distance_square(spark, sf_dir):
    pairs = distance.pairwise(by_sample(spark, sf_dir), "euclidean", K_PAIRS)
    return distance.square(pairs, "euclidean").select("sample_a", "sample_b", tidy("value").alias("value"))


@query
def distance_mahalanobis(spark, sf_dir):
    return ml.mahalanobis(by_sample(spark, sf_dir), 3)


# --- graph ---


@query
def edges(spark, sf_dir):
    return graph.indexed_edges(seqs(spark, sf_dir), K_PROFILE).select("idx", "seq_id", "pos1", "kmer_id1", "kmer1", "pos2", "kmer_id2", "kmer2")


@query
def weighted_edges(spark, sf_dir):
    return graph.weighted_edges(seqs(spark, sf_dir), K_EDGES)


@query
def distinct_edges(spark, sf_dir):
    return graph.distinct_edges(graph.weighted_edges(seqs(spark, sf_dir), K_EDGES))


@query
def nodes(spark, sf_dir):
    return graph.nodes_of(seqs(spark, sf_dir), K_EDGES).drop("sample")


@query
def degrees(spark, sf_dir):
    return graph.degrees(graph.weighted_edges(seqs(spark, sf_dir), K_EDGES))


@query
def smallest_degree(spark, sf_dir):
    return graph.smallest_degree(graph.degrees(graph.weighted_edges(seqs(spark, sf_dir), K_EDGES)))


@query
def kplus1mers(spark, sf_dir):
    return graph.augmented(graph.edges(seqs(spark, sf_dir), K_PROFILE)).groupBy("kmer").agg(F.count("*").alias("n"))


@query
def second_order_edges(spark, sf_dir):
    return graph.second_order(seqs(spark, sf_dir), 5)


# --- minimizers ---


@query
def stride_minimizers(spark, sf_dir):
    return minimizers.stride_minimizers(seqs(spark, sf_dir), K_PROFILE, WINDOW).drop("sample")


@query
def window_minimizers(spark, sf_dir):
    return minimizers.window_minimizers(seqs(spark, sf_dir), K_PROFILE, WINDOW).drop("sample")


@query
def minimizer_index(spark, sf_dir):
    return minimizers.window_minimizers(seqs(spark, sf_dir), K_PROFILE, WINDOW).where("is_min = 1").drop("sample")


@query
def seed_matches(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.lit("item").alias("sample"), F.col("item_id").alias("seq_id"), fn.clean(F.col("text")).alias("seq"))
    return minimizers.seed_matches(seqs(spark, sf_dir).drop("sample"), items.drop("sample"), K_SEEDS, WINDOW)


# --- codons ---


def _triplets(spark, sf_dir) -> DataFrame:
    s = seqs(spark, sf_dir)
    return s.select("seq_id", F.col("seq").substr(F.lit(1), F.length("seq") - F.length("seq") % 3).alias("seq"))


@query
def codon_counts(spark, sf_dir):
    return codons.counts(_triplets(spark, sf_dir)).select("seq_id", "codon", "codon_id", "aa", "count")


@query
def codon_counts_inner(spark, sf_dir):
    return codons.counts(_triplets(spark, sf_dir), include_start=False, include_stop=False).select("seq_id", "codon", "count")


@query
def codon_counts_cds(spark, sf_dir):
    return codons.counts(codons.coding(_triplets(spark, sf_dir))).select("seq_id", "codon", "count")


@query
def codon_table_wide(spark, sf_dir):
    return codons.table(codons.counts(_triplets(spark, sf_dir)))


@query
def codon_freq_length(spark, sf_dir):
    return codons.frequencies(codons.counts(_triplets(spark, sf_dir))).select("seq_id", "codon_id", tidy("freq_len", 9).alias("freq_len"))


@query
def codon_freq_family(spark, sf_dir):
    return codons.frequencies(codons.counts(_triplets(spark, sf_dir))).select("seq_id", "codon_id", tidy("freq_family", 9).alias("freq_family"))


@query
def expected_codons(spark, sf_dir):
    rows = codons.expected(codons.counts(_triplets(spark, sf_dir)), 3000)
    return rows.select("codon_id", F.col("expected").cast("long").alias("expected"), tidy("share", 9).alias("share"))


def _by_source(spark, sf_dir) -> DataFrame:
    """Codons of each source taken together: single texts are too short to expect every codon."""
    s = seqs(spark, sf_dir)
    return codons.counts(s.select(F.col("sample").alias("seq_id"), F.col("seq").substr(F.lit(1), F.length("seq") - F.length("seq") % 3).alias("seq")))


@query
def cub_chisq(spark, sf_dir):
    c = _by_source(spark, sf_dir)
    return codons.chi_square(c, c).select("seq_id", tidy("chisq").alias("chisq"))


@query
def cub_pvalue(spark, sf_dir):
    c = _by_source(spark, sf_dir)
    return codons.usage_bias(c, c).select("seq_id", tidy("chisq").alias("chisq"), "dof", tidy("pvalue").alias("pvalue"), tidy("bonferroni").alias("bonferroni"))


# --- probability ---


@query
def markov_log_odds(spark, sf_dir):
    s = seqs(spark, sf_dir)
    rows = probability.markov_log_odds(s, shred.profile_fast(s, K_SMALL, False), shred.profile_fast(s, 1, False), K_SMALL)
    return rows.select("seq_id", *[tidy(c).alias(c) for c in ("log_p", "log_null", "log_odds")])


# --- reduction and clustering ---


def _vectors(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


@query
def pca(spark, sf_dir):
    return ml.pca(by_sample(spark, sf_dir, K_EDGES), 3)


@query
def explained_variance(spark, sf_dir):
    return ml.explained_variance(by_sample(spark, sf_dir, K_EDGES))


@query
def kmeans(spark, sf_dir):
    return ml.kmeans(_vectors(spark, sf_dir), 10, id_col="vec_id", array_col="embedding")


@query
def kmeans_cosine(spark, sf_dir):
    return ml.kmeans(_vectors(spark, sf_dir), 10, "c", id_col="vec_id", array_col="embedding")


@query
def kmeans_samples(spark, sf_dir):
    return ml.kmeans(ml.sample_vectors(by_sample(spark, sf_dir), K_PAIRS), 4, "b")


@query
def kmeans_elbow(spark, sf_dir):
    return ml.kmeans_elbow(ml.sample_vectors(by_sample(spark, sf_dir), K_PAIRS), 5)


@query
def cluster_agreement(spark, sf_dir):
    found = kmeans(spark, sf_dir).join(_vectors(spark, sf_dir).select("vec_id", "label"), "vec_id")
    return ml.agreement(found, "label", "cluster")


@query
def cluster_ami(spark, sf_dir):
    found = kmeans(spark, sf_dir).join(_vectors(spark, sf_dir).select("vec_id", "label"), "vec_id")
    return ml.adjusted_mutual_information(found, "label", "cluster")


@query
def linkage(spark, sf_dir):
    return ml.linkage(distance.pairwise(by_sample(spark, sf_dir), "euclidean", K_PAIRS))


@query
def upgma(spark, sf_dir):
    return ml.upgma(distance.pairwise(by_sample(spark, sf_dir), "correlation", K_PAIRS))


@query
def tsne(spark, sf_dir):
    return ml.tsne(by_sample(spark, sf_dir), K_PAIRS)


# --- sources and sinks: what is written is read back ---


def _path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that ``spark.checkpoint.dir`` names; in a local session without it, in a temporary one."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        given = f"file://{tempfile.mkdtemp(prefix='strandlake-')}"
    return f"{given.rstrip('/')}/strandlake/{name}-{uuid.uuid4().hex}"


def _records(spark, sf_dir, record: Callable[[Column, Column], Column], ending: str) -> str:
    """Sequences written as text records in files with ``ending``."""
    path = _path(spark, "records")
    rows = seqs(spark, sf_dir).where(F.col("seq").isNotNull())
    rows.select(record(F.col("seq_id").cast("string"), F.col("seq")).alias("value")).write.text(path)
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.listStatus(spark._jvm.org.apache.hadoop.fs.Path(path)):
        file = status.getPath()
        if file.getName().endswith(".txt"):
            fs.rename(file, file.suffix(ending))
    return path


@query
def fasta_records(spark, sf_dir):
    path = _records(spark, sf_dir, lambda i, s: F.concat(F.lit(">"), i, F.lit(" a record\n"), F.regexp_replace(s, "(.{70})", "$1\n")), ".fasta")
    return sq.read_sequences(spark, f"{path}/*.fasta").select("seq_id", "seq")


@query
def fastq_records(spark, sf_dir):
    path = _records(spark, sf_dir, lambda i, s: F.concat(F.lit("@"), i, F.lit(" a read\n"), s, F.lit("\n+\n"), F.translate(s, "ACGT", "@+I5")), ".fastq")
    return sq.read_fastq(spark, f"{path}/*.fastq").select("seq_id", "seq", "qual")


@query
def file_checksums(spark, sf_dir):
    """The sums of one small file with known bytes."""
    path = _path(spark, "sums")
    spark.createDataFrame([("ACGT",)], "value string").coalesce(1).write.text(path)
    return sq.checksums(spark, f"{path}/*.txt").select("md5", "sha256", "n_bytes")


@query
def matrix_round_trip(spark, sf_dir):
    path = _path(spark, "matrix")
    tb.write_matrix(collate_wide(spark, sf_dir), path)
    rows = tb.read_matrix(spark, path, index="kmer_id").where("count > 0")
    return rows.select(F.col("row_id").cast("long").alias("kmer_id"), "sample", F.col("count").cast("long").alias("count"))


@query
def profile_round_trip(spark, sf_dir):
    path = _path(spark, "profile")
    p = whole_profile(spark, sf_dir, K_EDGES)
    tb.write_profile(p, pf.totals(p, K_EDGES), path, K_EDGES, "all")
    return tb.read_profile(spark, path, K_EDGES, "all").select("kmer_id", "count")


@query
def profile_text_round_trip(spark, sf_dir):
    path = _path(spark, "text")
    p = pf.with_index(pf.with_frequency(whole_profile(spark, sf_dir, K_EDGES)), "kmer_id", [])
    tb.export_profile(p, {"k": K_EDGES}, path)
    return tb.import_profile(spark, f"{path}/body")


@query
def edge_round_trip(spark, sf_dir):
    path = _path(spark, "edges")
    tb.write_edges(graph.weighted_edges(seqs(spark, sf_dir), K_EDGES), path)
    return tb.read_edges(spark, path)


@query
def minimizer_round_trip(spark, sf_dir):
    path = _path(spark, "minimizers")
    tb.write_minimizers(stride_minimizers(spark, sf_dir), path)
    return tb.read_minimizers(spark, path).select(F.col("seq_id").cast("long").alias("seq_id"), "pos", "kmer_id", "is_min")
