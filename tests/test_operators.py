import itertools
import random
from collections import Counter

import numpy as np
import pytest
from strandlake.operators import codons, distance, graph, kernels, matrix, minimizers, ml, probability, shred
from strandlake.operators import profile as pf

from tests.test_functions import code, rc

SEQS = [("a", 1, "ACGTACGTNACG"), ("a", 2, "AAAAAAA"), ("b", 3, "TTTTGGGRCCA"), ("b", 4, "AC"), ("b", 5, ""), ("a", 6, "GATTACA" * 5), ("b", 7, None)]


def table(spark, rows=SEQS):
    return spark.createDataFrame(rows, "sample string, seq_id long, seq string")


def counted(rows):
    return {r.kmer_id: r["count"] for r in rows.collect()}


def brute(k, fold=True, seqs=SEQS):
    out = Counter()
    for _, _, s in seqs:
        for i in range(len(s or "") - k + 1):
            w = s[i : i + k]
            if set(w) <= set("ACGT"):
                out[min(code(w), code(rc(w))) if fold else code(w)] += 1
    return dict(out)


@pytest.mark.parametrize("k", [1, 3, 4, 11])
@pytest.mark.parametrize("fold", [True, False])
def test_both_plans_match_brute_force(spark, k, fold):
    assert counted(shred.profile(table(spark), k, "drop", fold)) == brute(k, fold) == counted(shred.profile_fast(table(spark), k, fold))


def test_folding_the_forward_profile_gives_the_canonical_one(spark):
    forward, folded = brute(3, False), Counter()
    for i, n in forward.items():
        w = "".join("ACGT"[i >> 2 * (2 - j) & 3] for j in range(3))
        folded[min(i, code(rc(w)))] += n
    assert counted(shred.profile_fast(table(spark), 3)) == dict(folded)


def test_ambiguity(spark):
    one = table(spark, [("a", 1, "ARA")])
    assert counted(shred.profile(one, 3, "expand", False)) == {code("AAA"): 1, code("AGA"): 1} and counted(shred.profile(one, 3, "drop")) == {}
    assert [(r.pos, r.kmer) for r in shred.occurrences(one, 2, "expand", False).orderBy("pos", "kmer").collect()] == [(0, "AA"), (0, "AG"), (1, "AA"), (1, "GA")]
    with pytest.raises(ValueError):
        shred.occurrences(one, 2, "guess")


def test_strict_mode_names_the_unfit_sequence(spark):
    with pytest.raises(Exception, match="unfit sequence 4"):
        shred.occurrences(table(spark, [("b", 4, "AC")]), 3, strict=True).collect()


def test_chunks_keep_every_window_once(spark):
    for size in (5, 7, 100):
        assert counted(shred.profile_fast(shred.chunk(table(spark), 5, size), 5)) == brute(5)


def test_nullomers_and_totals(spark):
    p = shred.profile_fast(table(spark), 4)
    missing = {r.kmer_id for r in pf.nullomers(p, 4).collect()}
    assert pf.universe_size(4) == 136 and len(missing) + len(brute(4)) == 136 and not missing & set(brute(4))
    row = pf.totals(p, 4).first()
    assert (row.total_kmers, row.unique_kmers, row.nullomers, row.unique_nullomers_compat) == (sum(brute(4).values()), len(brute(4)), len(missing), 128 - len(brute(4)))


def test_an_empty_profile(spark):
    p = shred.profile_fast(table(spark, []), 3)
    assert counted(p) == {} and pf.totals(p, 3).first().total_kmers == 0 and pf.with_index(p, "kmer_id", []).collect() == []


def test_index_numbers_rows_in_order(spark):
    rows = spark.createDataFrame([(random.Random(i).randint(-50, 50), i) for i in range(300)], "a long, b long")
    got = sorted((r.idx, r.a, r.b) for r in pf.with_index(rows, "a", ["b"]).collect())
    assert [x[1:] for x in got] == sorted((r.a, r.b) for r in rows.collect()) and [x[0] for x in got] == list(range(300))


def test_shuffle_is_a_seeded_permutation(spark):
    p = shred.profile_fast(table(spark), 4)
    first, again, other = ([(r.idx, r.kmer_id) for r in pf.shuffle(p, s).orderBy("idx").collect()] for s in (1, 1, 2))
    assert first == again != other and {k for _, k in first} == set(brute(4)) and [i for i, _ in first] == list(range(len(first)))


def test_edges_are_all_consecutive_pairs(spark):
    got = graph.edges(table(spark), 4).collect()
    want = [(i, p) for _, i, s in SEQS for p in range(len(s or "") - 4) if set(s[p : p + 5]) <= set("ACGT")]
    assert sorted((r.seq_id, r.pos1) for r in got) == sorted(want) and all(r.pos2 == r.pos1 + 1 and r.kmer1[1:] == r.kmer2[:-1] for r in got)
    assert sum(r.weight for r in graph.weighted_edges(table(spark), 4).collect()) == len(want)
    assert sum(r.degree for r in graph.degrees(graph.weighted_edges(table(spark), 4)).collect()) == 2 * graph.weighted_edges(table(spark), 4).count()


def test_window_minimizers(spark):
    s = "GATTACAGATTTACAACGT"
    ids = [min(code(s[i : i + 3]), code(rc(s[i : i + 3]))) for i in range(len(s) - 2)]
    want = {min(range(i, i + 4), key=lambda j: (ids[j], j)) for i in range(len(ids) - 3)}
    got = minimizers.window_minimizers(table(spark, [("a", 1, s), ("a", 2, "ACGT")]), 3, 4).collect()
    assert {r.pos for r in got if r.is_min and r.seq_id == 1} == want and len([r for r in got if r.seq_id == 1]) == len(ids)
    assert sum(r.is_min for r in got if r.seq_id == 2) == 1


def test_codons(spark):
    rows = table(spark, [("a", 1, "ATGAAATCTAGCTAA"), ("a", 2, "ATGNAATAA")])
    got = {(r.seq_id, r.codon): r for r in codons.frequencies(codons.counts(rows)).collect()}
    assert got[1, "TCT"].freq_family == 0.5 and got[1, "AGC"].freq_family == 0.5 and got[1, "ATG"].freq_len == 0.2 and (2, "NAA") not in got
    assert {r.codon for r in codons.counts(rows, include_start=False, include_stop=False).where("seq_id = 1").collect()} == {"AAA", "TCT", "AGC"}
    with pytest.raises(Exception, match="not a coding sequence"):
        codons.coding(table(spark, [("a", 9, "AAA")]), ignore_invalid=False).collect()
    assert abs(codons.chi_square_tail(60.0, 60) - 0.4757) < 1e-3 and abs(codons.chi_square_tail(3.841459, 1) - 0.05) < 1e-6


def samples(spark, vectors):
    rows = [(f"s{i}", j, int(c)) for i, v in enumerate(vectors) for j, c in enumerate(v) if c]
    return spark.createDataFrame(rows, "sample string, kmer_id long, count long")


def test_distances_against_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 5, (4, 16)) * rng.integers(0, 2, (4, 16))
    x[3] = x[2]
    long = samples(spark, x)
    rank = lambda v: np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
    share = x / x.sum(1, keepdims=True)
    forms = {
        "pearson": lambda u, v: np.corrcoef(u, v)[0, 1], "spearman": lambda u, v: np.corrcoef(rank(u), rank(v))[0, 1], "euclidean": lambda u, v: np.linalg.norm(u - v),
        "cityblock": lambda u, v: np.abs(u - v).sum(), "chebyshev": lambda u, v: np.abs(u - v).max(), "hamming": lambda u, v: (u != v).mean(),
        "canberra": lambda u, v: np.nan_to_num(np.abs(u - v) / np.where(u + v > 0, u + v, 1)).sum(), "braycurtis": lambda u, v: np.abs(u - v).sum() / (u + v).sum(),
        "jaccard": lambda u, v: ((u > 0) != (v > 0)).sum() / ((u > 0) | (v > 0)).sum(), "d2": lambda u, v: (u * v).sum(),
    }
    for metric, form in forms.items():
        got = {(r.sample_a, r.sample_b): r.value for r in distance.pairwise(long, metric, 2).collect()}
        assert len(got) == 6
        for (a, b), value in got.items():
            assert value == pytest.approx(form(x[int(a[1])].astype(float), x[int(b[1])].astype(float)), abs=1e-9), metric
    cumulative = np.abs(np.cumsum(share[0]) - np.cumsum(share[1])).sum()
    assert {(r.sample_a, r.sample_b): r.value for r in distance.pairwise(long, "emd", 2).collect()}["s0", "s1"] == pytest.approx(cumulative)


def test_distances_at_the_edges(spark):
    long = samples(spark, [[1] * 16, [2, 3] + [0] * 14, [0, 0, 4, 5] + [0] * 12])
    got = {(r.sample_a, r.sample_b): r.value for r in distance.pairwise(long, "pearson", 2).collect()}
    assert got["s0", "s1"] is None and got["s1", "s2"] is not None
    assert {r.value for r in distance.pairwise(long, "yule", 2).where("sample_a = 's1'").collect()} == {2.0}
    whole = distance.square(distance.pairwise(long, "euclidean", 2), "euclidean").collect()
    assert len(whole) == 9 and all(r.value == 0 for r in whole if r.sample_a == r.sample_b)
    with pytest.raises(ValueError):
        distance.pairwise(long, "unheard", 2)


def test_size_factors(spark):
    x = np.array([[10, 20, 40, 0], [20, 40, 80, 5]])
    got = {r["sample"]: r.size_factor for r in matrix.size_factors(samples(spark, x)).collect()}
    assert got["s1"] / got["s0"] == pytest.approx(2) and got["s0"] * got["s1"] == pytest.approx(1)


def test_reduction_and_trees(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 50, (6, 16))
    names, scores, var = ml.pca_parts(samples(spark, x))
    centred = x - x.mean(0)
    assert np.allclose(np.linalg.norm(scores[:, None] - scores[None], axis=2), np.linalg.norm(centred[:, None] - centred[None], axis=2), atol=1e-6)
    assert np.allclose(sorted(var)[::-1][:5], np.linalg.eigvalsh(np.cov(x.T))[::-1][:5], atol=1e-6)
    points = np.array([0.0, 1.0, 5.0, 7.0])
    d = np.abs(points[:, None] - points[None])
    assert ml.merge_tree(d, "single") == [(0, 1, 1.0, 2), (2, 3, 2.0, 2), (4, 5, 4.0, 4)]
    assert ml.merge_tree(d, "average")[-1] == (4, 5, 5.5, 4)
    assert ml.merge_tree(d, "ward")[-1][2] == pytest.approx(np.sqrt(2 * 2 * 2 / 4) * 5.5)
    pairs = spark.createDataFrame([("a", "b", 2.0), ("a", "c", 6.0), ("b", "c", 6.0)], "sample_a string, sample_b string, value double")
    assert ml.newick(pairs) == "((a:1,b:1):2,c:3);" or ml.newick(pairs) == "(c:3,(a:1,b:1):2);"


def test_clusters(spark):
    x = [[0, 0, 1.0], [0, 0, 1.1], [9, 9, 1.0], [9, 9, 1.2]]
    rows = spark.createDataFrame([(f"s{i}", v) for i, v in enumerate([[float(y) for y in r] for r in x])], "sample string, x array<double>")
    for d in ("e", "b"):
        got = {r["sample"]: r.cluster for r in ml.kmeans(rows, 2, d).collect()}
        assert got["s0"] == got["s1"] != got["s2"] == got["s3"]
    same = spark.createDataFrame([(0, 5), (0, 5), (1, 7)], "a int, b int")
    assert ml.agreement(same, "a", "b").first().asDict() == {"homogeneity": 1.0, "completeness": 1.0, "v_measure": 1.0, "adjusted_rand": 1.0}


def test_streaming_profile_matches_the_batch_one(spark, tmp_path):
    from strandlake.streaming.profiles import running_profile

    rows = table(spark)
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = running_profile(stream, 3).writeStream.outputMode("complete").format("memory").queryName("running").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert counted(spark.table("running")) == brute(3)


def test_plans_have_what_they_should(spark):
    plan = lambda df: df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    docs = "/root/testdata/sf0.001/documents.parquet"
    from strandlake.sources.sequences import from_documents

    text = plan(shred.profile_fast(from_documents(spark.read.parquet(docs)), 8))
    assert "ReadSchema: struct<text:string>" in text and text.count("Exchange (") <= 2
    assert "Window" not in plan(pf.with_frequency(shred.profile_fast(table(spark), 8)))


def test_records_of_one_id_in_two_samples_stay_apart(spark):
    a, b = "GATTACAGATTTACAACGTCCGATGCATTGACCGATTACA", "TTGACCATGCCAGTACGGATTCACAGTTTGCAACCGGTAT"
    both = spark.createDataFrame([("x", "r", a), ("y", "r", b)], "sample string, seq_id string, seq string")
    one = lambda s: spark.createDataFrame([("x", "r", s)], "sample string, seq_id string, seq string")
    for f in (
        lambda t: minimizers.window_minimizers(t, 5, 4), lambda t: minimizers.stride_minimizers(t, 5, 4), lambda t: graph.edges(t, 5), lambda t: codons.frequencies(codons.counts(t)),
        lambda t: probability.markov_log_odds(t, shred.profile(one(a + b), 4, "drop", False), shred.profile(one(a + b), 1, "drop", False), 4),
    ):
        rows = lambda t, s: sorted(map(str, f(t).where(f"sample = '{s}'").drop("sample").collect()))  # noqa: E731, B023
        assert rows(both, "x") == rows(one(a), "x") and rows(both, "y") == sorted(map(str, f(one(b)).drop("sample").collect()))
    got = graph.indexed_edges(both, 5).orderBy("idx").collect()
    assert [r.idx for r in got] == list(range(len(a) + len(b) - 10)) and [(r["sample"], r.pos1) for r in got] == sorted((r["sample"], r.pos1) for r in got)
    twice = graph.indexed_edges(both.union(one(a)), 5).collect()
    assert sorted(r.idx for r in twice) == list(range(len(twice))) and len(twice) == 2 * len(a) + len(b) - 15


@pytest.mark.parametrize("block", [7, 64])
def test_kernels_give_the_same_in_blocks(spark, monkeypatch, block):
    rng = random.Random(9)
    rows = [("a", i, "".join(rng.choice("ACGT" * 6 + "N") for _ in range(rng.randint(0, 200)))) for i in range(30)]
    every = lambda: [sorted(map(str, f(table(spark, rows)).collect())) for f in (lambda t: minimizers.window_minimizers(t, 4, 6), lambda t: graph.indexed_edges(t, 4), codons.counts, lambda t: minimizers.stride_minimizers(t, 3, 5))]
    whole = every()
    blocks = kernels.blocks
    monkeypatch.setattr(kernels, "blocks", lambda seq, k: ((at, kernels.codes(seq[at : at + block + k - 1])) for at in range(0, max(1, len(seq) - k + 1), block)))
    for _, _, s in rows:
        made = [x for at, d in kernels.blocks(s.encode(), 4) for x in kernels.positions_and_ids(d, 4, True)[1].tolist()]
        assert made == [x for at, d in blocks(s.encode(), 4) for x in kernels.positions_and_ids(d, 4, True)[1].tolist()]
        small = [np.concatenate(x) if x else [] for x in zip(*kernels.minimizers(s.encode(), 4, 6, True))]
        kernels_blocks, kernels.blocks = kernels.blocks, blocks
        large = [np.concatenate(x) if x else [] for x in zip(*kernels.minimizers(s.encode(), 4, 6, True))]
        kernels.blocks = kernels_blocks
        assert all(np.array_equal(x, y) for x, y in zip(small, large))
    assert len(whole[0]) > 1000


def test_numbering_of_text_and_skewed_keys(spark, monkeypatch):
    monkeypatch.setattr(pf, "BUCKET_ROWS", 20)
    rng = random.Random(2)
    rows = spark.createDataFrame([("same" if i % 3 else f"id{rng.randint(0, 40)}", i) for i in range(400)], "a string, b long")
    placed = pf._bucketed(rows, ["a", "b"])
    assert placed.groupBy("__b").count().agg({"count": "max"}).first()[0] < 120
    got = sorted((r.idx, r.a, r.b) for r in pf.with_index(rows, "a", ["b"]).collect())
    assert [x[1:] for x in got] == sorted((r.a, r.b) for r in rows.collect()) and [x[0] for x in got] == list(range(400))
    summed = {r.b: r.s for r in pf.running_sum(rows, ["a", "b"], "b", "s").collect()}
    total = 0
    for a, b in sorted((r.a, r.b) for r in rows.collect()):
        assert summed[b] == total
        total += b


def test_canonical_ids_by_arithmetic(spark):
    from strandlake.functions import kmers as fn

    for k in (1, 2, 5, 31):
        rng = random.Random(k)
        rows = [("".join(rng.choice("ACGT") for _ in range(k)),) for _ in range(50)]
        got = spark.createDataFrame(rows, "kmer string").selectExpr("kmer").withColumn("a", fn.canonical(fn.F.col("kmer"))).withColumn("b", fn.canonical_id(fn.encode(fn.F.col("kmer")), k)).collect()
        assert all(r.a == r.b for r in got)


def test_moving_centres_follow_means_and_medians(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(3, 12)) * 5
    x = np.concatenate([b + rng.normal(size=(8, 12)) * 0.1 for b in base])
    truth = np.repeat(np.arange(3), 8)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    for d in "beaxkcus":
        for method in ("mean", "median"):
            got = [r.cluster for r in ml.kmeans(rows, 3, d, id_col="id", method=method).orderBy("id").collect()]
            assert len({(a, b) for a, b in zip(got, truth)}) == 3, (d, method)
    centres = np.array([[0.0, 0.0], [10.0, 10.0]])
    far = np.array([[1.0, 1.0], [9.0, 9.0], [9.0, 100.0]])
    assert ml._to_centres(far, centres, "b").argmin(axis=1).tolist() == [0, 1, 1]


def test_adjusted_mutual_information_against_all_permutations(spark):
    a, b = [0, 0, 0, 1, 1, 2], [0, 0, 1, 1, 1, 2]

    def mutual(x, y):
        n, joint = len(x), Counter(zip(x, y))
        p, q = Counter(x), Counter(y)
        return sum(c / n * np.log(n * c / (p[i] * q[j])) for (i, j), c in joint.items())

    chance = np.mean([mutual(a, list(p)) for p in itertools.permutations(b)])
    entropy = lambda x: -sum(c / len(x) * np.log(c / len(x)) for c in Counter(x).values())
    want = (mutual(a, b) - chance) / ((entropy(a) + entropy(b)) / 2 - chance)
    rows = spark.createDataFrame(list(zip(a, b)), "a int, b int")
    assert ml.adjusted_mutual_information(rows, "a", "b").first()[0] == pytest.approx(want)
    assert ml.adjusted_mutual_information(rows, "a", "a").first()[0] == pytest.approx(1.0)


def test_amino_profile(spark):
    rows = table(spark, [("a", 1, "MKVLA"), ("a", 2, "KVxKV"), ("b", 3, None), ("b", 4, "M")])
    from strandlake import alphabet as ab

    code_of = lambda w: sum(ab.AMINO_ACIDS.index(c) << 5 * (len(w) - 1 - i) for i, c in enumerate(w))
    assert counted(shred.amino_profile(rows, 2)) == {code_of("MK"): 1, code_of("KV"): 3, code_of("VL"): 1, code_of("LA"): 1}


def test_words_of_any_letters_are_counted_in_blocks(spark):
    from strandlake import alphabet as ab

    seq = "".join(random.Random(3).choice(ab.AMINO_ACIDS) for _ in range(2 * kernels.BLOCK + 50))
    rows = table(spark, [("a", 1, seq), ("b", 2, "MKxVé"), ("a", 3, None), ("b", 4, "M")])
    want = Counter(seq[i : i + 2] for i in range(len(seq) - 1)) + Counter(["MK"])
    counts = shred.word_counts(rows, 2, ab.AMINO_ACIDS)
    assert {r.kmer: r.n for r in counts.collect()} == dict(want)
    # Sequences are neither cut to substrings in the JVM, at a cost of their length squared, nor exploded.
    assert "Generate" not in counts._jdf.queryExecution().executedPlan().toString()
    by = {(r["sample"], r.kmer): r.n for r in shred.word_counts(table(spark), 6, "ACGT", ("sample",)).collect()}
    assert by == dict(Counter((x, s[i : i + 6]) for x, _, s in SEQS for i in range(len(s or "") - 5) if set(s[i : i + 6]) <= set("ACGT")))


def test_no_query_on_distinct_words_explodes_windows(spark):
    from strandlake.plans.queries import QUERIES

    for name in ["amino_encode", "kmer_encode"]:
        assert "posexplode" not in QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString(), name


def test_nodes_without_edges(spark):
    rng = random.Random(12)
    seq = lambda n: "".join(rng.choice("ACGT" * 5 + "N") for _ in range(n))
    for ids in ("long", "string"):
        rows = [(rng.choice(["x", "y", None]), rng.choice([None, *range(-5, 12)]), seq(rng.randint(0, 60))) for _ in range(60)] + [("x", 3, seq(100_000))]
        rows = [(a, i if ids == "long" or i is None else f"é{i}", s) for a, i, s in rows]
        t = spark.createDataFrame(rows, f"sample string, seq_id {ids}, seq string").repartition(3)
        for k in (3, 5):
            assert sorted(map(str, graph.nodes_of(t, k).collect())) == sorted(map(str, graph.nodes(graph.edges(t, k)).collect()))
    few = "/root/testdata/sf0.001"
    from strandlake.plans.queries import QUERIES

    assert "kmer_id2" not in QUERIES["nodes"](spark, few)._jdf.queryExecution().optimizedPlan().toString()


def test_seed_matches_need_no_join(spark, monkeypatch):
    rng = random.Random(21)
    seq = lambda n: "".join(rng.choice("ACGT" * 8 + "N") for _ in range(n))
    make = lambda rows: spark.createDataFrame(rows, "sample string, seq_id long, seq string")
    query = [(rng.choice("xy"), i, seq(rng.randint(0, 300))) for i in range(40)] + [("x", 90, None), (None, 91, seq(70_000))]
    items = make([(rng.choice(["p", None]), i % 15, seq(80)) for i in range(20)])
    rows = lambda q, r: sorted(map(str, minimizers.seed_matches(q, r, 4, 3).collect()))
    for q in (make(query), make(query + [("x", 3, seq(50)), query[5]])):
        for a, b in ((q, items), (q.drop("sample"), items.drop("sample"))):
            got = rows(a, b)
            with monkeypatch.context() as m:
                m.setattr(minimizers, "SEED_ROWS", 3)
                assert got == rows(a, b) and len(got) > 100
    plan = minimizers.seed_matches(make(query), items, 4, 3)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    assert minimizers.seed_matches(make(query), items.where("false"), 4, 3).collect() == []


def test_seed_pairs_are_counted_some_at_a_time(monkeypatch):
    index = np.array([1, 1, 2, 5, 5, 5]), np.array([0, 1, 0, 0, 1, 2]), [kernels.pa.array(["a", "b", "c"])]
    rows, ids = np.array([0, 0, 2, 2, 3]), np.array([1, 5, 2, 7, 5])
    found = lambda: [(int(r), c.as_py(), int(n)) for rs, (names, ns) in minimizers._matches(index, rows, ids) for r, c, n in zip(rs, names, ns)]
    want = [(0, "a", 2), (0, "b", 2), (0, "c", 1), (2, "a", 1), (3, "a", 1), (3, "b", 1), (3, "c", 1)]
    assert found() == want
    for most in (1, 4, 6):
        monkeypatch.setattr(minimizers, "MEETINGS", most)
        assert found() == want


def test_windows_and_occurrences_of_long_and_foreign_texts(spark):
    rng = random.Random(8)
    long = "".join(rng.choice("ACGT" * 9 + "N") for _ in range(kernels.BLOCK + 500))
    rows = table(spark, [("a", 1, "ACGTéACG\nTAC"), ("a", 2, long), ("b", 3, None), (None, 4, "AC"), ("b", None, "𝔸CGTA")])
    text = {r.seq_id: r.seq for r in rows.collect() if r.seq}
    got = shred.windows(rows, 3)
    cut = {(i, p, s[p : p + 3]) for i, s in text.items() for p in range(len(s) - 2)}
    assert {(r.seq_id, r.pos, r.kmer) for r in got.collect()} == cut and got.count() == len(cut)
    known = shred.occurrences(rows, 3, "drop")
    assert {(r.seq_id, r.pos, r.kmer, r.kmer_id) for r in known.collect()} == {(i, p, w, min(code(w), code(rc(w)))) for i, p, w in cut if set(w) <= set("ACGT")}
    assert all("posexplode" not in x._jdf.queryExecution().executedPlan().toString() for x in (got, known))


def test_a_kernel_holds_blocks_not_batches(spark):
    rng = random.Random(6)
    seqs = [None, b"", *("".join(rng.choice("ACGTN") for _ in range(rng.randint(0, 3000))).encode() for _ in range(200)), b"ACGTT" * kernels.BLOCK]
    whole = list(kernels.laid(seqs, 4))
    assert max(len(b.data) for b in whole) <= 2 * kernels.BLOCK + 3
    met = [(int(r), int(p)) for b in whole for r, p in zip(*b.place(b.whole(4)))]
    assert met == [(r, p) for r, s in enumerate(seqs) for p in range(len(s or b"") - 3)]
    shred.profile_fast(table(spark), 4)
    assert int(spark.conf.get(kernels.BATCH_BYTES).rstrip("b")) <= 2 << 20
    long = [("a", 1, "GATTACAN" * 20_000), ("a", 2, "ACGT")]
    got = {(r.k, r.kmer_id): r["count"] for r in shred.multi_k(table(spark, long), [2, 11]).collect()}
    assert got == {(k, i): n for k in (2, 11) for i, n in brute(k, seqs=long).items()}


def test_expanding_profile_has_no_windows_in_rows(spark):
    rows = [("a", 1, "ARANNTé" + "GATTACA" * 20), ("b", 2, "acgt"), ("b", 3, None)]
    got = shred.profile(table(spark, rows), 3, "expand", False)
    want = Counter()
    from strandlake import alphabet as ab

    for _, _, s in rows:
        for i in range(len(s or "") - 2):
            if all(c in ab.IUPAC for c in s[i : i + 3]):
                want.update(code("".join(w)) for w in itertools.product(*(ab.IUPAC[c] for c in s[i : i + 3])))
    assert counted(got) == dict(want)
    assert "posexplode" not in got._jdf.queryExecution().executedPlan().toString()


def test_ambiguous_words_are_counted_before_they_are_expanded(spark):
    from strandlake.plans.queries import QUERIES

    plan = QUERIES["iupac_expand"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "posexplode" not in plan and "MapInArrow" in plan


def test_log_odds_of_long_and_short_sequences(spark):
    rng = random.Random(14)
    rows = [("a", i, "".join(rng.choice("ACGT" * 9 + "N") for _ in range(n))) for i, n in enumerate([0, 2, 3, 5, 80_000, 150_000, 40])] + [("a", 9, None)]
    t = table(spark, rows)
    spark.conf.unset(kernels.BATCH_BYTES)
    got = {r.seq_id: r for r in probability.markov_log_odds(t, shred.profile_fast(t, 3, False), shred.profile_fast(t, 1, False), 3).collect()}
    count, base = brute(3, False, rows), brute(1, False, rows)
    for _, i, s in rows:
        ids = [(p, code(s[p : p + 3])) for p in range(len(s or "") - 2) if "N" not in s[p : p + 3]]
        if not ids:
            assert i not in got
            continue
        p = sum(np.log(count[j] / (sum(count.values()) if at == 0 else sum(count.get(j // 4 * 4 + x, 0) for x in range(4)))) for at, j in ids)
        q = sum(np.log(base[code(c)] / sum(base.values())) for c in s if c != "N")
        assert got[i].log_p == pytest.approx(p, rel=1e-9) and got[i].log_null == pytest.approx(q, rel=1e-9) and got[i].log_odds == pytest.approx(p - q, rel=1e-6)
    # A worker gets batches of bounded bytes.
    assert int(spark.conf.get(kernels.BATCH_BYTES).rstrip("b")) <= 2 << 20


def test_dropping_profile_counts_in_kernels(spark):
    got = shred.profile(table(spark), 3, "drop")
    assert counted(got) == brute(3) and "Generate" not in got._jdf.queryExecution().executedPlan().toString()


def test_indexed_edges_number_through_blocks_and_read_sequences_twice(spark):
    rng = random.Random(17)
    rows = [("a", i, "".join(rng.choice("ACGT" * 9 + "N") for _ in range(n))) for i, n in enumerate([0, 7, 150_000, 3, 70_000, 12])]
    got = [(r.idx, r.seq_id, r.pos1) for r in graph.indexed_edges(table(spark, rows), 6).orderBy("idx").collect()]
    want = [(i, p) for _, i, s in rows for p in range(len(s) - 6) if "N" not in s[p : p + 7]]
    assert got == [(n, *x) for n, x in enumerate(want)]
    plan = graph.indexed_edges(table(spark, rows), 6)._jdf.queryExecution().withCachedData().toString()
    assert "InMemoryRelation" in plan


def test_coding_sequences_are_cleaned_once(spark):
    from strandlake.functions import kmers as fn
    from strandlake.plans.queries import QUERIES

    plan = QUERIES["codon_counts_cds"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[0].count("regexp_replace(") == 1
    texts = ["ATGTAA", "GTGAAATAG", "ATGAAA", "ATGTA", "AT", "", None, "CTGTAA", "ATGéééTGA", "TTG", "ATGAATAA"]
    rows = table(spark, [("a", i, s) for i, s in enumerate(texts)])
    for every in (False, True):
        assert sorted(r.seq_id for r in codons.coding(rows, include_noncanonical=every).collect()) == sorted(r.seq_id for r in rows.where(fn.is_cds(spark_col("seq"), every)).collect())
    long = "".join(random.Random(4).choice("ACGT" * 9 + "N") for _ in range(200_000))
    got = {r.codon: r["count"] for r in codons.counts(table(spark, [("a", 1, long)]), False, False).collect()}
    want = Counter(long[i : i + 3] for i in range(3, len(long) // 3 * 3 - 3, 3))
    assert got == {c: n for c, n in want.items() if "N" not in c}


def spark_col(name):
    from pyspark.sql import functions as F

    return F.col(name)
