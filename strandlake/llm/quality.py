"""Operator 4, quality classifier: random Fourier features, ridge, isotonic calibration.

Document statistics are standardised over the corpus and lifted by random
Fourier features of a Gaussian kernel. Each partition of labelled rows sums its
share of the normal equations; the sums give ridge scores. Rows kept apart from
the ridge fit, binned by score, give the isotonic map from scores to
probabilities.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from strandlake.llm.common import cut, fresh, held_out, map_arrow, packed, written
from strandlake.llm.doc_stats import NAMES, stats

FEATURES = 256
BANDWIDTH = 5.0
RIDGE = 1e-3
SEED = 4
CUTOFF = 0.3
#: Score bins of the calibration, and partitions that hold sums of the normal equations.
BINS = 400
SUM_PARTS = 8
#: Rows of statistics of labelled documents count as this many short rows.
LABELLED_X = 10
#: Beyond this many deviations a standardised statistic is clipped, so odd texts stay near the fitted range.
CLIP = 6.0


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots_x: np.ndarray
    knots_y: np.ndarray


def fourier(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised rows lifted to FEATURES cosines and a constant."""
    rng = np.random.default_rng(SEED)
    w = rng.normal(0, 1 / BANDWIDTH, (x.shape[1], FEATURES))
    shift = rng.uniform(0, 2 * np.pi, FEATURES)
    z = np.clip((x - mean) / scale, -CLIP, CLIP)
    return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ w + shift), np.ones((len(x), 1))])


def _matrix(column) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64).reshape(-1, len(NAMES))


def document_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, x array<double>) for every row of ``docs``."""

    def run(batches):
        for b in batches:
            x = [stats(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])

    rows = packed(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(rows, run, "doc_id long, x array<double>")


def pool_adjacent(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted isotonic (rising) fit by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for value, weight in zip(y, w):
        blocks.append([value, weight, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v, u, n = blocks.pop()
            p = blocks[-1]
            p[0] = (p[0] * p[1] + v * u) / (p[1] + u)
            p[1] += u
            p[2] += n
    return np.array([v for v, _, n in blocks for _ in range(int(n))])


def _normal_equations(rows: DataFrame, mean: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums over rows (x, y) of z z' and z y: by partition, then by a few partitions, then here."""
    size = FEATURES + 1

    def out(total):
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    def part(batches):
        total = np.zeros((size, size + 1))
        for b in batches:
            z = fourier(_matrix(b.column(0)), mean, scale)
            y = b.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
            total[:, :size] += z.T @ z
            total[:, size] += z.T @ y
        yield from out(total)

    def merge(batches):
        total = np.zeros((size, size + 1))
        for b in batches:
            for s in b.column(0):
                total += np.frombuffer(s.as_py()).reshape(size, size + 1)
        yield from out(total)

    parts = map_arrow(rows.select("x", F.col("y").cast("double").alias("y")), part, "sums binary")
    sums = map_arrow(parts.repartition(SUM_PARTS), merge, "sums binary")
    total = sum((np.frombuffer(r.sums).reshape(size, size + 1) for r in sums.toLocalIterator()), np.zeros((size, size + 1)))
    return total[:, :size], total[:, size]


def ridge_scores(rows: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` columns and the raw ridge score of rows with ``x``."""

    def run(batches):
        for b in batches:
            raw = fourier(_matrix(b.column(len(keep))), model.mean, model.scale) @ model.weights
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(raw, pa.float64())], [*keep, "raw"])

    kinds = ", ".join(f"{k} {dict(rows.dtypes)[k]}" for k in keep)
    return map_arrow(rows.select(*keep, "x"), run, f"{kinds}, raw double")


def fit(table: DataFrame, labels: DataFrame, label_col: str = "quality") -> Model:
    """Fits on labelled rows that are not held out: three of four parts for the ridge, one for calibration.

    Labels other than 0 and 1 are left out. Without labels every score is the cutoff's neutral 0.5.
    """
    moments = table.select(F.posexplode("x").alias("k", "v")).groupBy("k").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).collect()
    mean, scale = np.zeros(len(NAMES)), np.ones(len(NAMES))
    for r in moments:
        mean[r.k], scale[r.k] = r.m, max(r.s, 1e-6)
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    known = labels.where(F.col(label_col).isin(0, 1) & ~held_out("doc_id")).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label_col).alias("y"))
    known = cut(known)
    rows = cut(table.join(known, "doc_id").select("x", "y", part.alias("part")), LABELLED_X * known.count())
    a, b = _normal_equations(rows.where("part <> 4"), mean, scale)
    n = a[-1, -1]
    model = Model(mean, scale, np.zeros(FEATURES + 1), np.array([0.0]), np.array([0.5]))
    if n == 0:
        return model
    penalty = RIDGE * n / FEATURES * np.eye(len(a))
    penalty[-1, -1] = 0
    model.weights = np.linalg.lstsq(a + penalty, b, rcond=None)[0]
    width = F.floor((F.greatest(F.lit(-0.5), F.least(F.lit(1.5), "raw")) + 0.5) * (BINS / 2)).cast("int")
    bins = ridge_scores(rows, model, ["y", "part"]).withColumn("bin", width)
    for own in ("part = 4", "true"):
        got = bins.where(own).groupBy("bin").agg(F.avg("raw").alias("x"), F.avg(F.col("y").cast("double")).alias("y"), F.count("*").alias("n")).orderBy("bin").collect()
        if got:
            break
    y, w = np.array([r.y for r in got]), np.array([r.n for r in got], np.float64)
    prior = float((y * w).sum() / w.sum())
    smooth = (y * w + prior * 0.5) / (w + 0.5)
    model.knots_x, model.knots_y = np.array([r.x for r in got]), pool_adjacent(smooth, w)
    return model


def calibrated(x: np.ndarray, model: Model) -> np.ndarray:
    """Scores in 0..1 of rows of statistics."""
    raw = fourier(x, model.mean, model.scale) @ model.weights
    return np.clip(np.interp(raw, model.knots_x, model.knots_y), 0, 1)


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "quality", cutoff: float = CUTOFF) -> DataFrame:
    """One row (doc_id, held_out, score, predicted) per row of ``docs``.

    The score is a calibrated probability of label 1 in 0..1 and rises with the
    ridge score. Null and empty texts have the score of zero statistics;
    repeated rows come out as often as they come in; null ids are scored and not
    held out; no rows give none.
    """
    table = cut(document_stats(docs))
    model = fit(table, labels, label_col)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(calibrated(_matrix(b.column(1)), model), pa.float64())], ["doc_id", "score"])

    scored = map_arrow(table, run, "doc_id long, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= cutoff).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, label_col: str = "quality", cutoff: float = CUTOFF) -> DataFrame:
    """Rows of ``docs`` that the classifier does not reject, each judged by its own text; columns stay as they are.

    Null and empty texts are judged by zero statistics, repeated rows each by
    themselves, null ids like others; no rows give none, and without labels all
    stay. The statistics are made once and written beside the rows.
    """
    names = docs.columns
    at = names.index("text")
    (made,) = fresh(docs, "x")

    def add(batches):
        for b in batches:
            text = b.column(at).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([stats(t.as_py()) for t in text], pa.list_(pa.float64()))], [*names, made])

    table = written(map_arrow(packed(docs), add, StructType([*docs.schema.fields, StructField(made, ArrayType(DoubleType()))])), "statistics")
    model = fit(table.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(made).alias("x")), labels, label_col)

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(calibrated(np.array(x.to_list(), np.float64).reshape(-1, len(NAMES)), model))

    return table.where(score(made) >= cutoff).select(names)
