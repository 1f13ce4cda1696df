"""Dimension reduction and clustering of samples.

Samples are few and k-mers many, so Spark makes the samples' inner products and
distances, and the small sample-by-sample matrix is solved in numpy. Its size is
checked. Rows of vectors (one a row) are clustered by MLlib.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators import distance as ds

#: Most samples whose matrix comes to the driver.
MAX_SAMPLES = 4000
LINKAGES = ("single", "complete", "average", "weighted", "centroid", "median", "ward")


def _square(pairs: DataFrame, diagonal: float) -> tuple[list[str], np.ndarray]:
    names = sorted(r[0] for r in pairs.select("sample_a").union(pairs.select("sample_b")).distinct().limit(MAX_SAMPLES + 1).collect())
    if len(names) > MAX_SAMPLES:
        raise ValueError(f"more than {MAX_SAMPLES} samples")
    at = {n: i for i, n in enumerate(names)}
    out = np.full((len(names), len(names)), diagonal)
    for r in pairs.toLocalIterator():
        out[at[r.sample_a], at[r.sample_b]] = out[at[r.sample_b], at[r.sample_a]] = r.value
    return names, out


def gram(long: DataFrame) -> tuple[list[str], np.ndarray]:
    """Samples and their inner products."""
    u = long.select("kmer_id", F.col("sample").alias("sample_a"), F.col("count").cast("double").alias("x"))
    v = long.select("kmer_id", F.col("sample").alias("sample_b"), F.col("count").cast("double").alias("y"))
    sums = u.join(v, "kmer_id").where("sample_a <= sample_b").groupBy("sample_a", "sample_b").agg(F.sum(F.col("x") * F.col("y")).alias("value"))
    return _square(sums, 0.0)


def pca_parts(long: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Samples, scores of all components (samples x components), and variances, largest first.

    Each component's sign makes its largest score positive.
    """
    names, g = gram(long)
    n = len(names)
    middle = np.eye(n) - 1 / n
    values, vectors = np.linalg.eigh(middle @ g @ middle)
    order = np.argsort(-values)
    values, vectors = np.clip(values[order], 0, None), vectors[:, order]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(n)] < 0, -1, 1)
    return names, vectors * np.sqrt(values), values / max(1, n - 1)


def pca(long: DataFrame, n: int) -> DataFrame:
    """Rows (sample, component, score) of the first ``n`` principal components."""
    names, scores, _ = pca_parts(long)
    rows = [(s, c, float(scores[i, c])) for i, s in enumerate(names) for c in range(min(n, scores.shape[1]))]
    return long.sparkSession.createDataFrame(rows, "sample string, component int, score double")


def explained_variance(long: DataFrame) -> DataFrame:
    """Rows (component, variance, ratio, cumulative): the elbow's data."""
    _, _, var = pca_parts(long)
    ratio = var / (var.sum() or 1)
    return long.sparkSession.createDataFrame([(i, float(v), float(r), float(c)) for i, (v, r, c) in enumerate(zip(var, ratio, np.cumsum(ratio)))], "component int, variance double, ratio double, cumulative double")


def mahalanobis(long: DataFrame, n: int) -> DataFrame:
    """Rows (sample_a, sample_b, value) on the first ``n`` principal components."""
    names, scores, _ = pca_parts(long)
    x = scores[:, :n]
    inverse = np.linalg.pinv(np.atleast_2d(np.cov(x.T)))
    rows = [(names[i], names[j], float(np.sqrt(max(0.0, (d := x[i] - x[j]) @ inverse @ d)))) for i in range(len(names)) for j in range(i + 1, len(names))]
    return long.sparkSession.createDataFrame(rows, "sample_a string, sample_b string, value double")


def vectors(rows: DataFrame, id_col: str, array_col: str) -> DataFrame:
    return rows.select(F.col(id_col), array_to_vector(F.col(array_col).cast("array<double>")).alias("features"))


def sample_vectors(long: DataFrame, k: int) -> DataFrame:
    """One row (sample, x) with the dense counts of a small k (4^k values)."""
    if k > 8:
        raise ValueError("dense vectors are made up to k = 8")
    near = F.map_from_entries(F.collect_list(F.struct("kmer_id", F.col("count").cast("double"))))
    full = F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(4**k - 1).cast("bigint")), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0)))
    return long.groupBy("sample").agg(near.alias("m")).select("sample", full.alias("x"))


def kmeans(rows: DataFrame, k: int, distance: str = "e", seed: int = 42, id_col: str = "sample", array_col: str = "x", method: str = "mean") -> DataFrame:
    """Rows (id, cluster). distance: e euclidean; u uncentred and c centred correlation (cosine of the vectors,
    or of the vectors less their mean); s rank correlation; b city-block; a, x the absolute forms of c, u; k Kendall's tau.

    ``method`` says how a centre follows its rows, 'mean' or 'median'. Means under e, u,
    c and s run in MLlib; all else moves centres in numpy, over a checked number of rows.
    """
    x = F.col(array_col).cast("array<double>")
    if distance in ("e", "u", "c", "s") and method == "mean":
        if distance == "s":
            x = F.transform(x, lambda v: F.size(F.filter(x, lambda y: y < v)) + (F.size(F.filter(x, lambda y: y == v)) + 1) / 2.0)
        if distance in ("c", "s"):
            mean = F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / F.size(x)
            x = F.transform(x, lambda v: v - mean)
        made = rows.select(F.col(id_col), x.alias("x"))
        made = vectors(made, id_col, "x")
        model = KMeans(k=k, seed=seed, distanceMeasure="euclidean" if distance == "e" else "cosine").fit(made)
        return model.transform(made).select(id_col, F.col("prediction").alias("cluster"))
    table = rows.select(id_col, x.alias("x")).orderBy(id_col).limit(MAX_SAMPLES + 1).collect()
    if len(table) > MAX_SAMPLES:
        raise ValueError(f"more than {MAX_SAMPLES} rows")
    data = np.array([r.x for r in table])
    labels = _moving_centres(data, k, distance, method, seed) if len(data) else []
    return rows.sparkSession.createDataFrame([(r[id_col], int(c)) for r, c in zip(table, labels)], f"{id_col} {dict(rows.dtypes)[id_col]}, cluster int")


def _ranks(x: np.ndarray) -> np.ndarray:
    """Ranks of each row's values; ties share their mean."""
    return np.array([(r[None, :] < r[:, None]).sum(axis=1) + ((r[None, :] == r[:, None]).sum(axis=1) + 1) / 2 for r in x])


def _to_centres(x: np.ndarray, centres: np.ndarray, distance: str) -> np.ndarray:
    """Distances (rows x centres)."""
    if distance == "b":
        return np.abs(x[:, None] - centres[None]).mean(axis=2)
    if distance == "e":
        return ((x[:, None] - centres[None]) ** 2).mean(axis=2)
    if distance == "k":
        signs = lambda r: np.sign(r[:, None] - r[None, :])
        of = [signs(c) for c in centres]
        return np.array([[1 - (a * b).sum() / max(1.0, np.sqrt((a * a).sum() * (b * b).sum())) for b in of] for a in map(signs, x)])
    if distance == "s":
        x, centres = _ranks(x), _ranks(centres)
    if distance in ("a", "x", "c", "u", "s"):
        unit = lambda m: np.divide(m, n := np.linalg.norm(m, axis=1, keepdims=True), out=np.zeros_like(m), where=n > 0)
        middle = lambda m: m - m.mean(axis=1, keepdims=True) if distance in ("a", "c", "s") else m
        near = unit(middle(x)) @ unit(middle(centres)).T
        return 1 - (np.abs(near) if distance in ("a", "x") else near)
    raise ValueError(f"unknown distance {distance}")


def _moving_centres(x: np.ndarray, k: int, distance: str, method: str, seed: int, rounds: int = 100) -> np.ndarray:
    """Labels of k clusters: each centre moves to the mean or median of its rows until no row changes its cluster.

    The first centre is a row picked by ``seed``, each next one the row furthest from those before.
    """
    if method not in ("mean", "median"):
        raise ValueError("method is 'mean' or 'median'")
    first = [int(np.random.default_rng(seed).integers(len(x)))]
    while len(first) < min(k, len(x)):
        first.append(int(_to_centres(x, x[first], distance).min(axis=1).argmax()))
    centres, label = x[first].astype(np.float64), np.full(len(x), -1)
    for _ in range(rounds):
        new = _to_centres(x, centres, distance).argmin(axis=1)
        if np.array_equal(new, label):
            break
        label = new
        for c in range(len(centres)):
            if (label == c).any():
                centres[c] = (np.median if method == "median" else np.mean)(x[label == c], axis=0)
    return label


def kmeans_elbow(rows: DataFrame, most: int, seed: int = 42, id_col: str = "sample", array_col: str = "x") -> DataFrame:
    """Rows (k, cost, silhouette) for k = 1..most; the silhouette of one cluster is null."""
    made = vectors(rows, id_col, array_col).cache()
    spread = rows.select(F.posexplode(F.col(array_col).cast("array<double>")).alias("i", "v")).groupBy("i").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("ss"), F.count("*").alias("n"))
    whole = spread.agg(F.sum(F.col("ss") - F.col("s") * F.col("s") / F.col("n"))).first()[0]
    out = [(1, float(whole or 0.0), None)]
    for k in range(2, most + 1):
        model = KMeans(k=k, seed=seed).fit(made)
        found = model.transform(made)
        score = ClusteringEvaluator().evaluate(found) if len(model.clusterCenters()) > 1 else None
        out.append((k, float(model.summary.trainingCost), score))
    made.unpersist()
    return rows.sparkSession.createDataFrame(out, "k int, cost double, silhouette double")


def agreement(labels: DataFrame, a: str, b: str) -> DataFrame:
    """One row (homogeneity, completeness, v_measure, adjusted_rand) of two labelings, from their contingency counts."""
    table = [(r[0], r[1], r[2]) for r in labels.groupBy(a, b).agg(F.count("*").alias("n")).toLocalIterator()]
    n = sum(c for _, _, c in table)
    rows, cols = {}, {}
    for x, y, c in table:
        rows[x], cols[y] = rows.get(x, 0) + c, cols.get(y, 0) + c
    h = lambda m: -sum(c / n * np.log(c / n) for c in m.values())
    joint = -sum(c / n * np.log(c / n) for *_, c in table)
    mutual = h(rows) + h(cols) - joint
    hom, com = (mutual / h(rows) if h(rows) else 1.0), (mutual / h(cols) if h(cols) else 1.0)
    two = lambda c: c * (c - 1) / 2
    index, ra, rb = sum(two(c) for *_, c in table), sum(map(two, rows.values())), sum(map(two, cols.values()))
    chance = ra * rb / max(1, two(n))
    rand = 1.0 if ra + rb == 2 * chance else (index - chance) / ((ra + rb) / 2 - chance)
    v = 2 * hom * com / (hom + com) if hom + com else 0.0
    return labels.sparkSession.createDataFrame([(float(hom), float(com), float(v), float(rand))], "homogeneity double, completeness double, v_measure double, adjusted_rand double")


def adjusted_mutual_information(labels: DataFrame, a: str, b: str) -> DataFrame:
    """One row (adjusted_mutual_information): mutual information above its mean over all ways to deal the labels, as a share of the most there could be."""
    table = [(r[0], r[1], r[2]) for r in labels.groupBy(a, b).agg(F.count("*").alias("n")).toLocalIterator()]
    n = sum(c for *_, c in table)
    rows, cols = {}, {}
    for x, y, c in table:
        rows[x], cols[y] = rows.get(x, 0) + c, cols.get(y, 0) + c
    entropy = lambda m: -sum(c / n * math.log(c / n) for c in m.values())
    mutual = sum(c / n * math.log(n * c / (rows[x] * cols[y])) for x, y, c in table)
    fact = lambda v: math.lgamma(v + 1)
    chance = 0.0
    # Sizes repeat, so each pair of sizes is worked out once.
    for p, np_ in Counter(rows.values()).items():
        for q, nq in Counter(cols.values()).items():
            for c in range(max(1, p + q - n), min(p, q) + 1):
                weight = math.exp(fact(p) + fact(q) + fact(n - p) + fact(n - q) - fact(n) - fact(c) - fact(p - c) - fact(q - c) - fact(n - p - q + c))
                chance += np_ * nq * c / n * math.log(n * c / (p * q)) * weight
    most = (entropy(rows) + entropy(cols)) / 2
    value = 1.0 if abs(most - chance) < 1e-15 else (mutual - chance) / (most - chance)
    return labels.sparkSession.createDataFrame([(float(value),)], "adjusted_mutual_information double")


def merge_tree(d: np.ndarray, method: str) -> list[tuple[int, int, float, int]]:
    """Merges (left, right, height, size) of a distance matrix; new clusters are numbered from its size up."""
    if method not in LINKAGES:
        raise ValueError(f"unknown linkage {method}")
    squared = method in ("centroid", "median", "ward")
    n = len(d)
    d = d.astype(np.float64) ** (2 if squared else 1)
    np.fill_diagonal(d, np.inf)
    name, size, alive, out = list(range(n)), np.ones(n), list(range(n)), []
    for step in range(n - 1):
        sub = d[np.ix_(alive, alive)]
        i, j = divmod(int(sub.argmin()), len(alive))
        a, b = sorted((alive[i], alive[j]))
        h, na, nb = d[a, b], size[a], size[b]
        left, right = sorted((name[a], name[b]))
        out.append((left, right, float(np.sqrt(h) if squared else h), int(na + nb)))
        rest = np.array([c for c in alive if c not in (a, b)], int)
        if len(rest):
            x, y, nc = d[a, rest], d[b, rest], size[rest]
            new = {
                "single": lambda: np.minimum(x, y), "complete": lambda: np.maximum(x, y),
                "average": lambda: (na * x + nb * y) / (na + nb), "weighted": lambda: (x + y) / 2,
                "centroid": lambda: (na * x + nb * y) / (na + nb) - na * nb * h / (na + nb) ** 2, "median": lambda: (x + y) / 2 - h / 4,
                "ward": lambda: ((na + nc) * x + (nb + nc) * y - nc * h) / (na + nb + nc),
            }[method]()
            d[a, rest] = d[rest, a] = new
        name[a], size[a] = n + step, na + nb
        alive.remove(b)
    return out


def _tree(spark: SparkSession, names: list[str], merges) -> DataFrame:
    rows = [(i, *m) for i, m in enumerate(merges)]
    return spark.createDataFrame(rows, "step int, left int, right int, height double, size int")


def linkage(pairs: DataFrame, method: str = "ward", metric_rows: bool = True) -> DataFrame:
    """Merge table of a pairwise distance table. With ``metric_rows`` the matrix's rows are the observations,
    whose euclidean distances are merged; else the distances themselves are."""
    names, d = _square(pairs, 0.0)
    if metric_rows:
        d = np.sqrt(np.maximum(0, (d * d).sum(1)[:, None] + (d * d).sum(1)[None] - 2 * d @ d.T))
        np.fill_diagonal(d, 0)
    return _tree(pairs.sparkSession, names, merge_tree(d, method))


def upgma(pairs: DataFrame) -> DataFrame:
    return linkage(pairs, "average", metric_rows=False)


def newick(pairs: DataFrame) -> str:
    """The UPGMA tree as Newick text; branch lengths are half the heights' differences."""
    names, d = _square(pairs, 0.0)
    text, height = dict(enumerate(names)), dict.fromkeys(range(len(names)), 0.0)
    for i, (a, b, h, _) in enumerate(merge_tree(d, "average"), len(names)):
        text[i] = f"({text[a]}:{h / 2 - height[a]:g},{text[b]}:{h / 2 - height[b]:g})"
        height[i] = h / 2
    return text[max(text)] + ";" if text else ";"


def tsne(long: DataFrame, k: int, n: int = 2, perplexity: float = 5.0, rounds: int = 500, seed: int = 42) -> DataFrame:
    """Rows (sample, dim, value) of an exact t-SNE on the samples' squared euclidean distances."""
    names, d = _square(ds.pairwise(long, "sqeuclidean", k), 0.0)
    m = len(names)
    p = np.zeros((m, m))
    for i in range(m):
        own = np.delete(d[i], i)
        low, high, beta = 0.0, np.inf, 1 / max(own.mean(), 1e-12) if m > 1 else 1.0
        for _ in range(64):
            w = np.exp(-(own - own.min()) * beta) if m > 1 else own
            q = w / w.sum() if m > 1 else w
            gap = -(q * np.log(np.maximum(q, 1e-300))).sum() - np.log(min(perplexity, max(1.0, m - 1)))
            if abs(gap) < 1e-6:
                break
            low, high = (beta, high) if gap > 0 else (low, beta)
            beta = beta * 2 if np.isinf(high) else (low + high) / 2
        p[i, np.arange(m) != i] = q
    p = np.maximum((p + p.T) / (2 * m), 1e-12)
    rng = np.random.default_rng(seed)
    y, step = rng.normal(0, 1e-4, (m, n)), np.zeros((m, n))
    for r in range(rounds):
        gap = y[:, None] - y[None]
        w = 1 / (1 + (gap * gap).sum(2))
        np.fill_diagonal(w, 0)
        q = np.maximum(w / w.sum(), 1e-12)
        pull = (p * 4 if r < 100 else p) - q
        step = (0.5 if r < 100 else 0.8) * step - 20 * 4 * ((pull * w)[:, :, None] * gap).sum(1)
        y = y + step - (y + step).mean(0)
    return long.sparkSession.createDataFrame([(s, j, float(y[i, j])) for i, s in enumerate(names) for j in range(n)], "sample string, dim int, value double")
