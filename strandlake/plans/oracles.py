"""SQL for the named queries, for an independent engine over the same tables."""

from __future__ import annotations

from strandlake import alphabet as ab
from strandlake.plans.queries import K_EDGES, K_PAIRS, K_PROFILE, K_SEEDS, K_SMALL, SAMPLES, WINDOW

IUPAC_LETTERS = "".join(ab.IUPAC)


def enc(s: str, k: int) -> str:
    return f"CAST(list_sum(list_transform(range({k}), lambda i: (strpos('ACGT', substr({s}, CAST(i AS INTEGER) + 1, 1)) - 1) * CAST(4 ** ({k} - 1 - i) AS BIGINT))) AS BIGINT)"


def rc(s: str) -> str:
    return f"reverse(translate({s}, '{ab.COMPLEMENT_FROM}', '{ab.COMPLEMENT_TO}'))"


def canon(s: str, k: int) -> str:
    return f"least({enc(s, k)}, {enc(rc(s), k)})"


def tidy(x: str, n: int = 6) -> str:
    return f"round({x}, {n}) + 0.0"


def seqs(letters: str = "ACGT") -> str:
    return f"seqs AS (SELECT source AS sample, doc_id AS seq_id, upper(regexp_replace(text, '[^{letters}{letters.lower()}]', '', 'g')) AS seq FROM documents)"


def win(k: int, name: str = "win") -> str:
    return f"{name} AS (SELECT sample, seq_id, pos, substr(seq, pos + 1, {k}) AS kmer FROM (SELECT *, CAST(unnest(range(length(seq) - {k} + 1)) AS INTEGER) AS pos FROM seqs WHERE length(seq) >= {k}))"


def prof(k: int, fold: bool = True, by: str = "", name: str = "prof", of: str = "win") -> str:
    make = canon("kmer", k) if fold else enc("kmer", k)
    keys = f"{by}, " if by else ""
    return f"{name} AS (SELECT {keys}kmer_id, CAST(sum(n) AS BIGINT) AS count FROM (SELECT {keys}n, {make} AS kmer_id FROM (SELECT {keys}kmer, count(*) AS n FROM {of} GROUP BY {keys}kmer)) GROUP BY {keys}kmer_id)"


def universe(k: int) -> str:
    kmer = f"list_aggregate(list_transform(range({k}), lambda j: substr('ACGT', CAST((g // CAST(4 ** ({k} - 1 - j) AS BIGINT)) % 4 AS INTEGER) + 1, 1)), 'string_agg', '')"
    return f"uni AS (SELECT kmer_id, kmer FROM (SELECT g AS kmer_id, {kmer} AS kmer FROM range({4**k}) r(g)))"


def size(k: int) -> int:
    return (4**k + (4 ** (k // 2) if k % 2 == 0 else 0)) // 2


def base(k: int, fold: bool = True, by: str = "") -> str:
    return f"WITH {seqs()}, {win(k)}, {prof(k, fold, by)}"


distinct = f"WITH {seqs()}, {win(K_SMALL)}, d AS (SELECT DISTINCT kmer FROM win)"
letters = "WITH w AS (SELECT DISTINCT seq FROM (SELECT unnest(regexp_split_to_array(upper(regexp_replace(text, '[^A-Za-z ]', '', 'g')), ' +')) AS seq FROM documents) WHERE seq <> '')"
chars = "list_sort(list_distinct(regexp_extract_all(seq, '.')))"
amino_map = "CASE " + " ".join(f"WHEN codon = '{c}' THEN '{a}'" for c, a in ab.CODON_AMINO.items()) + " END"
nz = "substr({s}, {i}, 3)"


def among(letters_: str, keep: bool) -> str:
    return f"list_aggregate(list_filter({chars}, lambda c: {'' if keep else 'NOT '}contains('{letters_}', c)), 'string_agg', '')"


def listed(parts: list[str]) -> str:
    rows = " UNION ALL ".join(f"SELECT kmer, {i} AS n, {p} AS neighbor_id FROM d" for i, p in enumerate(parts))
    return f"{distinct} {rows}"


LEFT = [canon(f"('{c}' || substr(kmer, 1, {K_SMALL - 1}))", K_SMALL) for c in "ACGT"]
RIGHT = [canon(f"(substr(kmer, 2) || '{c}')", K_SMALL) for c in "ACGT"]
codes = "VALUES " + ", ".join(f"('{c}', '{x}')" for c, v in ab.IUPAC.items() for x in v)
amb = f"codes(c, x) AS ({codes})"
expanded = "ex AS (SELECT w.kmer, a.x || b.x || c.x AS expansion FROM (SELECT DISTINCT kmer FROM win) w JOIN codes a ON a.c = substr(w.kmer, 1, 1) JOIN codes b ON b.c = substr(w.kmer, 2, 1) JOIN codes c ON c.c = substr(w.kmer, 3, 1))"

SQL: dict[str, str] = {
    "seq_clean": f"WITH {seqs()} SELECT * FROM seqs",
    "seq_stats": f"""{base(K_SMALL, True, 'sample')}, r AS (SELECT sample, count(*) AS total_reads, CAST(min(length(seq)) AS INTEGER) AS min_read_length, CAST(max(length(seq)) AS INTEGER) AS max_read_length,
        CAST(floor(sum(length(seq)) / count(*)) AS INTEGER) AS avg_read_length FROM seqs GROUP BY sample),
        o AS (SELECT sample, CAST(sum(count) AS BIGINT) AS total_kmers, count(*) AS unique_kmers FROM prof GROUP BY sample)
        SELECT sample, total_reads, min_read_length, max_read_length, avg_read_length, coalesce(total_kmers, 0) AS total_kmers, coalesce(unique_kmers, 0) AS unique_kmers,
        {size(K_SMALL)} - coalesce(unique_kmers, 0) AS nullomers, {4**K_SMALL} - coalesce(unique_kmers, 0) AS nullomers_compat FROM r LEFT JOIN o USING (sample)""",
    "is_na": f"{letters} SELECT seq, regexp_full_match(seq, '[{IUPAC_LETTERS}]*') AS is_na, NOT regexp_full_match(seq, '[{IUPAC_LETTERS}]*') AND regexp_full_match(seq, '[{ab.AMINO_ACIDS}BZJX]*') AS is_aa FROM w",
    "iupac_symbols": f"""{letters} SELECT seq, list_aggregate({chars}, 'string_agg', '') AS letters, coalesce({among(ab.EXTENDED + 'N', True)}, '') AS extended,
        coalesce({among(IUPAC_LETTERS, False)}, '') AS non_iupac, CAST(length(seq) AS INTEGER) AS seq_len FROM w""",
    "is_cds": f"WITH {seqs()} SELECT seq_id, length(seq) % 3 = 0 AND length(seq) >= 3 AND substr(seq, 1, 3) IN {ab.STARTS} AND right(seq, 3) IN {ab.STOPS} AS is_cds, length(seq) % 3 = 0 AND length(seq) >= 3 AS is_cds_any FROM seqs",
    "revcomp": f"{distinct} SELECT kmer, {rc('kmer')} AS revcomp FROM d",
    "are_neighbors": f"""WITH {seqs()}, {win(K_SMALL + 2)}, w AS (SELECT DISTINCT kmer FROM win),
        p AS (SELECT substr(kmer, 1, {K_SMALL}) AS kmer1, substr(kmer, 2, {K_SMALL}) AS kmer2 FROM w UNION SELECT substr(kmer, 1, {K_SMALL}), substr(kmer, 3, {K_SMALL}) FROM w),
        q AS (SELECT kmer1, kmer2, substr(kmer1, 2) IN (substr(kmer2, 1, {K_SMALL - 1}), substr({rc('kmer2')}, 1, {K_SMALL - 1})) AS is_right,
        substr(kmer1, 1, {K_SMALL - 1}) IN (substr(kmer2, 2), substr({rc('kmer2')}, 2)) AS is_left FROM p) SELECT *, is_right OR is_left AS is_neighbor FROM q""",
    "number_checks": "SELECT DISTINCT token, regexp_full_match(token, '[+-]?[0-9]+') AS is_integer FROM (SELECT unnest(string_split(regexp_replace(props, '[^A-Za-z0-9.+-]+', ' ', 'g'), ' ')) AS token FROM events) WHERE token <> ''",
    "kmer_encode": f"{distinct} SELECT kmer, {enc('kmer', K_SMALL)} AS kmer_id FROM d",
    "kmer_decode": f"WITH {universe(K_SMALL)} SELECT kmer_id, kmer FROM uni",
    "canonical_id": f"{distinct} SELECT kmer, {canon('kmer', K_SMALL)} AS kmer_id FROM d",
    "left_neighbors": listed(LEFT),
    "right_neighbors": listed(RIGHT),
    "neighbors": listed(LEFT + RIGHT),
    "iupac_expand": f"WITH {seqs(IUPAC_LETTERS)}, {win(3)}, {amb}, {expanded} SELECT kmer, expansion FROM ex",
    "codon_translate": f"WITH {universe(3)} SELECT kmer AS codon, kmer_id AS codon_id, {amino_map} AS aa FROM (SELECT kmer, kmer_id, kmer AS codon FROM uni)",
    "sample_names": "SELECT url, regexp_extract(url, '([^/.]+)[^/]*$', 1) AS sample FROM pages",
    "kmer_occurrences": f"WITH {seqs()}, {win(K_PROFILE)}, d AS (SELECT kmer, {canon('kmer', K_PROFILE)} AS kmer_id FROM (SELECT DISTINCT kmer FROM win)) SELECT seq_id, pos, kmer, kmer_id FROM win JOIN d USING (kmer)",
    "profile_canonical": f"{base(K_PROFILE)} SELECT * FROM prof",
    "profile_forward": f"{base(K_PROFILE, False)} SELECT * FROM prof",
    "profile_expressions": f"{base(K_EDGES)} SELECT * FROM prof",
    "profile_frequency": f"{base(K_EDGES)} SELECT kmer_id, count, {tidy('count / sum(count) OVER ()', 12)} AS frequency FROM prof",
    "composite_by_source": f"{base(K_SMALL, True, 'sample')} SELECT * FROM prof",
    "multi_k": f"WITH {seqs()}, " + ", ".join(f"{win(k, f'w{k}')}, {prof(k, True, '', f'p{k}', f'w{k}')}" for k in (4, 5, 6)) + " " + " UNION ALL ".join(f"SELECT {k} AS k, kmer_id, count FROM p{k}" for k in (4, 5, 6)),
    "profile_chunked": f"{base(K_PROFILE)} SELECT * FROM prof",
    "no_ambiguous": f"WITH {seqs('ACGTN')}, {win(3)}, ok AS (SELECT * FROM win WHERE NOT contains(kmer, 'N')), {prof(3, True, '', 'prof', 'ok')} SELECT * FROM prof",
    "ambiguous_expand": f"WITH {seqs(IUPAC_LETTERS)}, {win(3)}, {amb}, {expanded}, n AS (SELECT kmer, count(*) AS n FROM win GROUP BY kmer) SELECT {canon('expansion', 3)} AS kmer_id, CAST(sum(n) AS BIGINT) AS count FROM ex JOIN n USING (kmer) GROUP BY 1",
    "nullomers": f"{base(K_PROFILE)}, {universe(K_PROFILE)} SELECT kmer_id FROM uni WHERE {canon('kmer', K_PROFILE)} = kmer_id AND kmer_id NOT IN (SELECT kmer_id FROM prof)",
    "nullomer_count": f"{base(K_PROFILE)} SELECT {size(K_PROFILE)} - count(*) AS nullomers, {4**K_PROFILE // 2} - count(*) AS unique_nullomers_compat FROM prof",
    "histogram": f"{base(K_PROFILE)} SELECT count, count(*) AS n_kmers FROM prof WHERE count > 2 GROUP BY count",
    "coverage_peak": f"{base(K_PROFILE)}, h AS (SELECT count AS peak_count, count(*) AS peak_height FROM prof WHERE count > 2 GROUP BY count) SELECT peak_count, peak_height FROM h ORDER BY peak_height DESC, peak_count LIMIT 1",
    "argmax_kmer": f"{base(K_PROFILE)} SELECT kmer_id, count FROM prof ORDER BY count DESC, kmer_id LIMIT 1",
    "no_singletons": f"{base(K_PROFILE)} SELECT * FROM prof WHERE count > 2",
    "sort_by_count": f"{base(K_SMALL)} SELECT row_number() OVER (ORDER BY count DESC, kmer_id) - 1 AS idx, kmer_id, count FROM prof",
    "row_number": f"{base(K_EDGES)} SELECT row_number() OVER (ORDER BY kmer_id) - 1 AS idx, kmer_id, count, {tidy('count / sum(count) OVER ()', 12)} AS frequency FROM prof",
    "header_totals": f"{base(K_PROFILE)} SELECT {K_PROFILE} AS k, CAST(sum(count) AS BIGINT) AS total_kmers, count(*) AS unique_kmers, {size(K_PROFILE)} - count(*) AS nullomers, {4**K_PROFILE // 2} - count(*) AS unique_nullomers_compat FROM prof",
}

# --- matrices ---

matrix = base(K_PAIRS, True, "sample")


def wide(names: dict[str, str]) -> str:
    return ", ".join(f"CAST(coalesce(sum(count) FILTER (WHERE sample = '{s}'), 0) AS BIGINT) AS {n}" for s, n in names.items())


factors = f"""{matrix}, ns AS (SELECT count(DISTINCT sample) AS n FROM prof), m AS (SELECT kmer_id, avg(ln(count)) AS lm FROM prof GROUP BY kmer_id HAVING count(*) = (SELECT n FROM ns)),
    f AS (SELECT sample, median(count / exp(lm)) AS size_factor FROM prof JOIN m USING (kmer_id) GROUP BY sample)"""
SQL |= {
    "collate_wide": f"{matrix} SELECT kmer_id, {wide({s: s for s in SAMPLES})} FROM prof GROUP BY kmer_id",
    "collate_dense": f"{base(5, True, 'sample')}, {universe(5)} SELECT kmer_id, {wide({s: s for s in SAMPLES})} FROM (SELECT * FROM uni WHERE {canon('kmer', 5)} = kmer_id) LEFT JOIN prof USING (kmer_id) GROUP BY kmer_id",
    "renamed_columns": f"{matrix} SELECT kmer_id, {wide({s: f'column_{i}' for i, s in enumerate(SAMPLES)})} FROM prof GROUP BY kmer_id",
    "frequency_matrix": f"{matrix} SELECT sample, kmer_id, {tidy('count / sum(count) OVER (PARTITION BY sample)', 9)} AS frequency FROM prof",
    "size_factors": f"{factors} SELECT sample, {tidy('size_factor', 9)} AS size_factor FROM f",
    "normalized": f"{factors} SELECT sample, kmer_id, {tidy('count / size_factor')} AS normalized FROM prof JOIN f USING (sample)",
}

# --- distances: every metric over the whole universe, zeros and all ---


def dense(k: int) -> str:
    return f"""{base(k, True, 'sample')}, s AS (SELECT DISTINCT sample FROM prof), full_ AS (SELECT s.sample, g AS kmer_id, CAST(coalesce(count, 0) AS DOUBLE) AS u
        FROM s CROSS JOIN range({4**k}) r(g) LEFT JOIN prof ON prof.sample = s.sample AND prof.kmer_id = g),
        sh AS (SELECT *, u / sum(u) OVER (PARTITION BY sample) AS f FROM full_),
        pairs AS (SELECT a.sample AS sample_a, b.sample AS sample_b, a.kmer_id, a.u, b.u AS v, a.f AS p, b.f AS q FROM sh a JOIN sh b ON a.kmer_id = b.kmer_id AND a.sample < b.sample)"""


flags = """c AS (SELECT sample_a, sample_b, CAST(count(*) FILTER (WHERE u > 0 AND v > 0) AS DOUBLE) AS tt, CAST(count(*) FILTER (WHERE u > 0 AND v = 0) AS DOUBLE) AS tf,
    CAST(count(*) FILTER (WHERE u = 0 AND v > 0) AS DOUBLE) AS ft, CAST(count(*) FILTER (WHERE u = 0 AND v = 0) AS DOUBLE) AS ff, CAST(count(*) FILTER (WHERE u <> v) AS DOUBLE) AS ne, CAST(count(*) AS DOUBLE) AS n FROM pairs GROUP BY ALL)"""
ranks = """rk AS (SELECT sample, kmer_id, rank() OVER (PARTITION BY sample ORDER BY u) + (count(*) OVER (PARTITION BY sample, u) - 1) / 2.0 AS u FROM full_),
    rp AS (SELECT a.sample AS sample_a, b.sample AS sample_b, a.u, b.u AS v FROM rk a JOIN rk b ON a.kmer_id = b.kmer_id AND a.sample < b.sample)"""
SUMS = {
    "pearson": "corr(u, v)", "correlation": "1 - corr(u, v)", "cosine": "1 - sum(u * v) / (sqrt(sum(u * u)) * sqrt(sum(v * v)))", "euclidean": "sqrt(sum((u - v) * (u - v)))",
    "sqeuclidean": "sum((u - v) * (u - v))", "cityblock": "sum(abs(u - v))", "minkowski": "sqrt(sum((u - v) * (u - v)))", "braycurtis": "sum(abs(u - v)) / sum(u + v)",
    "canberra": "sum(CASE WHEN u + v > 0 THEN abs(u - v) / (u + v) ELSE 0 END)",
    "jensenshannon": "sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * ln(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(2 * q / (p + q)) ELSE 0 END) / 2))",
    "d2": "sum(u * v)", "likelihood_ratio": "2 * coalesce(sum(u * log2(u / v)) FILTER (WHERE u > 0 AND v > 0), 0)",
}
COUNTS = {
    "hamming": "ne / n", "matching": "(tf + ft) / n", "jaccard": "(tf + ft) / (tt + tf + ft)", "jaccard_counts": "ne / (tt + tf + ft)", "dice": "(tf + ft) / (2 * tt + tf + ft)",
    "kulsinski": "(tf + ft - tt + n) / (tf + ft + n)", "rogerstanimoto": "2 * (tf + ft) / (tt + ff + 2 * (tf + ft))", "russellrao": "(n - tt) / n",
    "sokalmichener": "2 * (tf + ft) / (tt + ff + 2 * (tf + ft))", "sokalsneath": "2 * (tf + ft) / (tt + 2 * (tf + ft))",
    "yule": "CASE WHEN tf * ft = 0 THEN 0 ELSE 2 * tf * ft / (tt * ff + tf * ft) END", "matching_share": "(n - ne) / n",
}
for _m, _x in SUMS.items():
    SQL[f"distance_{_m}"] = f"{dense(K_PAIRS)} SELECT sample_a, sample_b, {tidy(_x)} AS value FROM pairs GROUP BY ALL"
for _m, _x in COUNTS.items():
    SQL[f"distance_{_m}"] = f"{dense(K_PAIRS)}, {flags} SELECT sample_a, sample_b, {tidy(_x)} AS value FROM c"
SQL |= {
    "distance_spearman": f"{dense(K_PAIRS)}, {ranks} SELECT sample_a, sample_b, {tidy('corr(u, v)')} AS value FROM rp GROUP BY ALL",
    "distance_chebyshev": f"{dense(K_SMALL)} SELECT sample_a, sample_b, {tidy('max(abs(u - v))')} AS value FROM pairs GROUP BY ALL",
    "distance_seuclidean": f"{dense(K_SMALL)}, vr AS (SELECT kmer_id, var_samp(u) AS w FROM full_ GROUP BY kmer_id HAVING var_samp(u) > 0) SELECT sample_a, sample_b, {tidy('sqrt(sum((u - v) * (u - v) / w))')} AS value FROM pairs JOIN vr USING (kmer_id) GROUP BY ALL",
    "distance_emd": f"{dense(K_SMALL)}, cu AS (SELECT sample, kmer_id, sum(f) OVER (PARTITION BY sample ORDER BY kmer_id) AS c FROM sh) SELECT a.sample AS sample_a, b.sample AS sample_b, {tidy('sum(abs(a.c - b.c))')} AS value FROM cu a JOIN cu b ON a.kmer_id = b.kmer_id AND a.sample < b.sample GROUP BY ALL",
    "distance_square": f"""{dense(K_PAIRS)}, e AS (SELECT sample_a, sample_b, {tidy('sqrt(sum((u - v) * (u - v)))')} AS value FROM pairs GROUP BY ALL)
        SELECT * FROM e UNION ALL SELECT sample_b, sample_a, value FROM e UNION ALL SELECT sample, sample, 0.0::DOUBLE FROM s""",
}

# --- graph ---


def coded(k: int, from_: str = "win") -> str:
    return f"co AS (SELECT kmer, {canon('kmer', k)} AS kmer_id FROM (SELECT DISTINCT kmer FROM {from_}))"


def edge_list(k: int) -> str:
    return f"""WITH {seqs()}, {win(k)}, {coded(k)}, e AS (SELECT a.seq_id, a.pos AS pos1, x.kmer_id AS kmer_id1, a.kmer AS kmer1, b.pos AS pos2, y.kmer_id AS kmer_id2, b.kmer AS kmer2
        FROM win a JOIN win b ON a.seq_id = b.seq_id AND b.pos = a.pos + 1 JOIN co x ON x.kmer = a.kmer JOIN co y ON y.kmer = b.kmer)"""


def weighted(k: int) -> str:
    return f"{edge_list(k)}, we AS (SELECT kmer_id1, kmer_id2, count(*) AS weight FROM e GROUP BY ALL)"


deg = f"{weighted(K_EDGES)}, dg AS (SELECT kmer_id, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i + o) AS BIGINT) AS degree FROM (SELECT kmer_id1 AS kmer_id, 1 AS o, 0 AS i FROM we UNION ALL SELECT kmer_id2, 0, 1 FROM we) GROUP BY kmer_id)"
SQL |= {
    "edges": f"{edge_list(K_PROFILE)} SELECT row_number() OVER (ORDER BY seq_id, pos1) - 1 AS idx, * FROM e",
    "weighted_edges": f"{weighted(K_EDGES)} SELECT * FROM we",
    "distinct_edges": f"{weighted(K_EDGES)} SELECT kmer_id1, kmer_id2 FROM we",
    "nodes": f"""{edge_list(K_EDGES)}, n AS (SELECT kmer_id1 AS kmer_id, seq_id, pos1 AS pos, kmer1 AS kmer FROM e UNION ALL SELECT kmer_id2, seq_id, pos2, kmer2 FROM e),
        r AS (SELECT *, row_number() OVER (PARTITION BY kmer_id ORDER BY seq_id, pos, kmer) AS rn FROM n) SELECT kmer_id, seq_id, pos, kmer FROM r WHERE rn = 1""",
    "degrees": f"{deg} SELECT * FROM dg",
    "smallest_degree": f"{deg} SELECT kmer_id, degree FROM dg ORDER BY degree, kmer_id LIMIT 1",
    "kplus1mers": f"WITH {seqs()}, {win(K_PROFILE + 1)} SELECT kmer, count(*) AS n FROM win GROUP BY kmer",
    "second_order_edges": f"{weighted(6)} SELECT * FROM we",
}

# --- minimizers ---


def minimized(k: int, table: str = "seqs", tag: str = "") -> str:
    return f"""mw{tag} AS (SELECT seq_id, pos, substr(seq, pos + 1, {k}) AS kmer FROM (SELECT seq_id, seq, CAST(unnest(range(length(seq) - {k} + 1)) AS INTEGER) AS pos FROM {table} WHERE length(seq) >= {k})),
        mk{tag} AS (SELECT kmer, {canon('kmer', k)} AS kmer_id FROM (SELECT DISTINCT kmer FROM mw{tag})), mo{tag} AS (SELECT seq_id, pos, kmer_id FROM mw{tag} JOIN mk{tag} USING (kmer)),
        ms{tag} AS (SELECT *, count(*) OVER (PARTITION BY seq_id) AS n, min(kmer_id * 4294967296 + pos) OVER (PARTITION BY seq_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) % 4294967296 AS mp FROM mo{tag}),
        mc{tag} AS (SELECT DISTINCT seq_id, CAST(mp AS INTEGER) AS pos FROM ms{tag} WHERE pos < greatest(1, n - {WINDOW - 1})),
        mi{tag} AS (SELECT o.seq_id, o.pos, o.kmer_id, CASE WHEN c.pos IS NULL THEN 0 ELSE 1 END AS is_min FROM mo{tag} o LEFT JOIN mc{tag} c ON c.seq_id = o.seq_id AND c.pos = o.pos)"""


SQL |= {
    "stride_minimizers": f"WITH {seqs()}, {win(K_PROFILE)}, {coded(K_PROFILE)} SELECT seq_id, pos, kmer_id, CAST(pos % {WINDOW} = 0 AS INTEGER) AS is_min FROM win JOIN co USING (kmer)",
    "window_minimizers": f"WITH {seqs()}, {minimized(K_PROFILE)} SELECT * FROM mi",
    "minimizer_index": f"WITH {seqs()}, {minimized(K_PROFILE)} SELECT * FROM mi WHERE is_min = 1",
    "seed_matches": f"""WITH {seqs()}, items AS (SELECT item_id AS seq_id, upper(regexp_replace(text, '[^ACGTacgt]', '', 'g')) AS seq FROM benchmark), {minimized(K_SEEDS)}, {minimized(K_SEEDS, 'items', 'r')},
        q AS (SELECT DISTINCT seq_id AS query_id, kmer_id FROM mi WHERE is_min = 1), r AS (SELECT DISTINCT seq_id AS reference_id, kmer_id FROM mir WHERE is_min = 1)
        SELECT query_id, reference_id, count(*) AS n_seeds FROM q JOIN r USING (kmer_id) GROUP BY ALL""",
}

# --- codons ---


def triplets(first: int = 0, last: int = 0, where: str = "length(seq) >= 3") -> str:
    return f"""WITH {seqs()}, t AS (SELECT seq_id, substr(seq, 1, length(seq) - length(seq) % 3) AS seq FROM seqs),
        cw AS (SELECT seq_id, substr(seq, CAST(i AS INTEGER) * 3 + 1, 3) AS codon FROM (SELECT seq_id, seq, unnest(range({first}, length(seq) // 3 - {last})) AS i FROM t WHERE {where})),
        cc AS (SELECT seq_id, codon, CAST({enc('codon', 3)} AS INTEGER) AS codon_id, {amino_map} AS aa, count(*) AS count FROM cw GROUP BY ALL)"""


cds = f"length(seq) >= 3 AND substr(seq, 1, 3) IN {ab.STARTS} AND right(seq, 3) IN {ab.STOPS}"
SQL |= {
    "codon_counts": f"{triplets()} SELECT seq_id, codon, codon_id, aa, count FROM cc",
    "codon_counts_inner": f"{triplets(1, 1)} SELECT seq_id, codon, count FROM cc",
    "codon_counts_cds": f"{triplets(where=cds)} SELECT seq_id, codon, count FROM cc",
    "codon_table_wide": f"{triplets()} SELECT seq_id, " + ", ".join(f"CAST(coalesce(sum(count) FILTER (WHERE codon = '{c}'), 0) AS BIGINT) AS {c}" for c in ab.CODONS) + " FROM cc GROUP BY seq_id",
    "codon_freq_length": f"{triplets()} SELECT seq_id, codon_id, {tidy('count / sum(count) OVER (PARTITION BY seq_id)', 9)} AS freq_len FROM cc",
    "codon_freq_family": f"{triplets()} SELECT seq_id, codon_id, {tidy('count / sum(count) OVER (PARTITION BY seq_id, aa)', 9)} AS freq_family FROM cc",
    "expected_codons": f"""{triplets()}, s AS (SELECT codon_id, sum(count) AS n FROM cc GROUP BY codon_id), x AS (SELECT codon_id, CAST(floor(n / (SELECT sum(n) FROM s) * (3000 / 3)) AS BIGINT) AS expected FROM s)
        SELECT codon_id, expected, {tidy('expected / (SELECT sum(expected) FROM x)', 9)} AS share FROM x""",
    "cub_chisq": f"""{triplets().replace("SELECT seq_id, substr(seq, 1", "SELECT sample AS seq_id, substr(seq, 1")}, s AS (SELECT codon_id, sum(count) AS n FROM cc WHERE aa <> '*' GROUP BY codon_id), sh AS (SELECT codon_id, n / (SELECT sum(n) FROM s) AS share FROM s),
        z AS (SELECT seq_id, sum(count) AS size, sum(count) FILTER (WHERE aa <> '*') AS sense FROM cc GROUP BY seq_id),
        w AS (SELECT z.seq_id, sense, codon_id, floor(share * size) AS e FROM z CROSS JOIN sh WHERE sense > 0),
        m AS (SELECT w.*, coalesce(count, 0) / sense AS o, e / sum(e) OVER (PARTITION BY w.seq_id) AS ex, min(e) OVER (PARTITION BY w.seq_id) AS least FROM w LEFT JOIN cc ON cc.seq_id = w.seq_id AND cc.codon_id = w.codon_id)
        SELECT seq_id, {tidy('sum((o - ex) * (o - ex) / ex)')} AS chisq FROM m WHERE least > 0 GROUP BY seq_id HAVING count(*) = {len(ab.SENSE)}""",
    "markov_log_odds": f"""WITH {seqs()}, {win(K_SMALL)}, {coded(K_SMALL).replace(canon('kmer', K_SMALL), enc('kmer', K_SMALL))}, pr AS (SELECT kmer_id, count(*) AS n FROM win JOIN co USING (kmer) GROUP BY 1),
        st AS (SELECT kmer_id, ln(n / sum(n) OVER (PARTITION BY kmer_id // 4)) AS step, ln(n / sum(n) OVER ()) AS start FROM pr),
        lp AS (SELECT seq_id, sum(CASE WHEN pos = 0 THEN start ELSE step END) AS log_p FROM win JOIN co USING (kmer) JOIN st USING (kmer_id) GROUP BY seq_id),
        b1 AS (SELECT seq_id, unnest(regexp_extract_all(seq, '.')) AS b FROM seqs), bs AS (SELECT b, ln(count(*) / (SELECT count(*) FROM b1)) AS lb FROM b1 GROUP BY b),
        lq AS (SELECT seq_id, sum(lb) AS log_null FROM b1 JOIN bs USING (b) GROUP BY seq_id)
        SELECT seq_id, {tidy('log_p')} AS log_p, {tidy('log_null')} AS log_null, {tidy('log_p - log_null')} AS log_odds FROM lp JOIN lq USING (seq_id)""",
}

# --- more of profiles and codons ---

SQL |= {
    "shuffle": f"{base(K_SMALL)} SELECT row_number() OVER (ORDER BY md5(kmer_id || ':42'), kmer_id) - 1 AS idx, kmer_id, count FROM prof",
    "header_document": f"""{SQL['seq_stats'].replace('SELECT sample, total_reads,', ', st AS (SELECT sample, total_reads,', 1)}),
        whole AS (SELECT kmer_id, sum(count) AS n FROM prof GROUP BY kmer_id)
        SELECT CAST(to_json({{'k': {K_SMALL}, 'total_kmers': CAST(sum(n) AS BIGINT), 'unique_kmers': count(*), 'nullomers': {size(K_SMALL)} - count(*), 'unique_nullomers_compat': {4**K_SMALL // 2} - count(*),
            'files': (SELECT list(f ORDER BY f) FROM (SELECT {{'avg_read_length': avg_read_length, 'max_read_length': max_read_length, 'min_read_length': min_read_length, 'nullomers': nullomers, 'nullomers_compat': nullomers_compat,
            'sample': sample, 'total_kmers': total_kmers, 'total_reads': total_reads, 'unique_kmers': unique_kmers}} AS f FROM st)), 'sorted': false, 'tags': CAST([] AS VARCHAR[]), 'comments': CAST([] AS VARCHAR[])}}) AS VARCHAR) AS header FROM whole""",
    "cub_pvalue": f"""WITH raw AS ({SQL['cub_chisq'].replace(tidy('sum((o - ex) * (o - ex) / ex)'), 'sum((o - ex) * (o - ex) / ex)')}),
        tail AS (SELECT seq_id, chisq, exp(-chisq / 2) * list_sum(list_transform(range({(len(ab.SENSE) - 1) // 2}), lambda i: pow(chisq / 2, i) / factorial(CAST(i AS INTEGER)))) AS p FROM raw)
        SELECT seq_id, {tidy('chisq')} AS chisq, CAST({len(ab.SENSE) - 1} AS INTEGER) AS dof, {tidy('p')} AS pvalue, {tidy('least(1.0, p * (SELECT count(*) FROM tail))')} AS bonferroni FROM tail""",
    "fasta_records": f"WITH {seqs()} SELECT CAST(seq_id AS VARCHAR) AS seq_id, seq FROM seqs WHERE seq IS NOT NULL",
    "fastq_records": f"WITH {seqs()} SELECT CAST(seq_id AS VARCHAR) AS seq_id, seq, translate(seq, 'ACGT', '@+I5') AS qual FROM seqs WHERE seq IS NOT NULL",
    "file_checksums": "SELECT md5('ACGT' || chr(10)) AS md5, sha256('ACGT' || chr(10)) AS sha256, CAST(5 AS BIGINT) AS n_bytes",
    "matrix_round_trip": f"{matrix} SELECT kmer_id, sample, count FROM prof",
    "profile_round_trip": f"{base(K_EDGES)} SELECT * FROM prof",
    "profile_text_round_trip": f"{base(K_EDGES)} SELECT * FROM prof",
    "edge_round_trip": f"{weighted(K_EDGES)} SELECT * FROM we",
    "minimizer_round_trip": f"WITH {seqs()}, {win(K_PROFILE)}, {coded(K_PROFILE)} SELECT seq_id, pos, kmer_id, 1 AS is_min FROM win JOIN co USING (kmer) WHERE pos % {WINDOW} = 0",
}

# --- amino acids ---

_amino_id = f"(strpos('{ab.AMINO_ACIDS}', substr(kmer, 1, 1)) - 1) * 32 + strpos('{ab.AMINO_ACIDS}', substr(kmer, 2, 1)) - 1"
SQL |= {
    "amino_profile": f"WITH {seqs(ab.AMINO_ACIDS)}, {win(2)} SELECT CAST({_amino_id} AS BIGINT) AS kmer_id, CAST(sum(n) AS BIGINT) AS count FROM (SELECT kmer, count(*) AS n FROM win GROUP BY kmer) GROUP BY 1",
    "amino_encode": f"WITH {seqs(ab.AMINO_ACIDS)}, {win(2)} SELECT DISTINCT kmer, CAST({_amino_id} AS BIGINT) AS kmer_id FROM win",
}
