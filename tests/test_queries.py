"""Queries against their SQL on the smallest tables."""

import sys

import duckdb
import pytest

import __spark_entry__ as entry
from strandlake.plans.oracles import SQL
from strandlake.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark events".split()
#: Each operator family by several queries; the driver runs them all.
CHOSEN = [
    "seq_stats", "iupac_symbols", "are_neighbors", "neighbors", "iupac_expand", "profile_canonical", "multi_k", "profile_chunked", "ambiguous_expand",
    "nullomers", "coverage_peak", "sort_by_count", "collate_dense", "normalized", "distance_spearman", "distance_seuclidean", "distance_yule", "distance_jensenshannon",
    "edges", "nodes", "degrees", "window_minimizers", "seed_matches", "codon_freq_family", "markov_log_odds",
]


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", CHOSEN)
def test_query_matches_sql(spark, oracle, name):
    got, want = QUERIES[name](spark, SF).toPandas(), oracle.execute(SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns) and len(got) == len(want)
    key = lambda df: sorted(map(tuple, df[cols].astype(str).values.tolist()))
    assert key(got) == key(want)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).columns == ["kmer_id", "count"]
    assert set(QUERIES) <= set(entry.queries())


def test_the_rest_works_without_the_subpackage(monkeypatch):
    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("strandlake.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "strandlake.llm", None)
    assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) == set(SQL)


def test_collate_wide_keeps_every_source(spark, tmp_path):
    rows = [(1, "ACGTAC", "src0"), (2, "ACGT", "else.where"), (3, "ACG", None), (4, "", "empty")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["collate_wide"](spark, str(tmp_path))
    assert got.columns == ["kmer_id", *(f"src{i}" for i in range(20)), "else.where", "empty", "null"]
    table = got.toPandas()
    assert [int(table[c].sum()) for c in ("src0", "src1", "else.where", "empty", "null")] == [4, 0, 2, 0, 1]


def test_collate_wide_matches_sql(spark, oracle):
    test_query_matches_sql(spark, oracle, "collate_wide")


@pytest.mark.parametrize("name", ["collate_dense", "renamed_columns"])
def test_every_source_is_a_column(spark, tmp_path, name):
    rows = [(1, "ACGTACGTAC", "src0"), (2, "ACGTACG", "else.where"), (3, "ACGTA", None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    table = QUERIES[name](spark, str(tmp_path)).toPandas()
    assert [int(table[c].sum()) for c in table.columns[1:]] == ([6, *[0] * 19, 3, 1] if name == "collate_dense" else [8, *[0] * 19, 5, 3])


@pytest.mark.parametrize("name", ["header_document", "cub_pvalue", "shuffle", "fasta_records", "fastq_records", "matrix_round_trip", "profile_text_round_trip", "edge_round_trip", "minimizer_round_trip", "renamed_columns"])
def test_more_queries_match_sql(spark, oracle, name):
    test_query_matches_sql(spark, oracle, name)
