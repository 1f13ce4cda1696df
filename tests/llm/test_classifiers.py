import random
import zlib

import numpy as np
from strandlake.llm import label_model, quality, toxicity
from strandlake.llm.doc_stats import NAMES, stats

from tests.llm.helpers import awkward, docs, labels


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 0


def corpus(n=500):
    random.seed(11)
    syllables = "la mo ti ra ne so ku vi do pe".split()
    word = lambda: "".join(random.choice(syllables) for _ in range(random.randint(1, 4)))
    rows, marks = [], []
    for i in range(n):
        words = [word() for _ in range(random.randint(30, 120))]
        bad, toxic = i % 5 == 1, i % 7 == 2
        if toxic:
            for _ in range(4):
                words[random.randrange(len(words))] = random.choice(["idiot", "scum"]) if i % 2 else "zzqx" + random.choice(syllables) + random.choice(syllables)
        if bad:
            words = [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words) + ".", f"s{i % 4}"))
        marks.append((i, int(not bad), int(toxic)))
    return rows, marks


def test_statistics_are_finite():
    for t in [t for _, t, _ in awkward()] + ["\ud800".encode("utf-8", "replace").decode(), "!!!", "\n\n", "a"]:
        x = stats(t)
        assert len(x) == len(NAMES) and np.isfinite(x).all()


def test_pooling_is_the_isotonic_fit():
    y, w = np.array([0.3, 0.1, 0.2, 0.9, 0.8, 0.8, 1.0]), np.array([1.0, 2, 1, 1, 1, 2, 1])
    got = quality.pool_adjacent(y, w)
    assert (np.diff(got) >= 0).all() and np.isclose((got * w).sum(), (y * w).sum()) and np.allclose(got, [0.5 / 3] * 2 + [0.2] + [0.825] * 3 + [1.0])


def test_partition_sums_are_the_normal_equations(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(60, len(NAMES))), rng.integers(0, 2, 60)
    mean, scale = np.zeros(len(NAMES)), np.ones(len(NAMES))
    rows = spark.createDataFrame([(r.tolist(), int(v)) for r, v in zip(x, y)], "x array<double>, y int").repartition(5)
    a, b = quality._normal_equations(rows, mean, scale)
    z = quality.fourier(x, mean, scale)
    assert np.allclose(a, z.T @ z) and np.allclose(b, z.T @ y)


def test_quality_on_held_out_rows_and_awkward_ones(spark):
    rows, marks = corpus()
    odd = [(i if i is None else i + 10_000, t, s) for i, t, s in awkward()]
    table, known = docs(spark, rows + odd), labels(spark, marks)
    got = quality.classify(table, known).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == held(r.doc_id) for r in got)
    truth = {i: q for i, q, _ in marks}
    test = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in test) >= 0.95 * len(test)
    flipped = labels(spark, [(i, 1 - q if held(i) else q, t) for i, q, t in marks])
    assert sorted((str(r.doc_id), r.score) for r in quality.classify(table, flipped).collect()) == sorted((str(r.doc_id), r.score) for r in got)
    kept = {r.doc_id for r in quality.keep_good(docs(spark, rows), known).collect()}
    assert kept == {r.doc_id for r in got if r.predicted and r.doc_id in truth}


def test_toxicity_on_held_out_rows_and_awkward_ones(spark):
    rows, marks = corpus()
    odd = [(i if i is None else i + 10_000, t, s) for i, t, s in awkward()]
    table, known = docs(spark, rows + odd), labels(spark, marks)
    got = toxicity.classify(table, known).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == held(r.doc_id) for r in got)
    assert not any(r.predicted for r in got if r.doc_id is None or r.doc_id >= 9000)
    truth = {i: t for i, _, t in marks}
    test = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in test) >= 0.97 * len(test)
    flipped = labels(spark, [(i, q, 1 - t if held(i) else t) for i, q, t in marks])
    assert sorted((str(r.doc_id), r.score) for r in toxicity.classify(table, flipped).collect()) == sorted((str(r.doc_id), r.score) for r in got)


def test_nothing_to_learn_from(spark):
    none = labels(spark, [])
    assert quality.classify(docs(spark, []), none).collect() == [] == toxicity.classify(docs(spark, []), none).collect()
    assert {r.score for r in quality.classify(docs(spark, awkward()), none).collect()} == {0.5}
    assert not any(r.predicted for r in toxicity.classify(docs(spark, awkward()), none).collect())
    nulls = spark.createDataFrame([(None, None, None), (3, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert len(quality.classify(docs(spark, awkward()), nulls).collect()) == len(toxicity.classify(docs(spark, awkward()), nulls).collect()) == len(awkward())


def test_label_model_finds_accuracies_and_repeats():
    rng = np.random.default_rng(3)
    y = rng.random(20_000) < 0.1
    rate = [(0.01, 0.8), (0.02, 0.6), (0.001, 0.7), (0.3, 0.35)]
    votes = np.array([rng.random(len(y)) < np.where(y, b, a) for a, b in rate]).T
    votes = np.hstack([votes, votes[:, :1]])  # the last voter repeats the first
    pattern, n = np.unique(votes @ (1 << np.arange(5)), return_counts=True)
    m = label_model.fit(pattern, n, 5, 0.1)
    assert abs(m.fire[1, 2] - 0.7) < 0.1 and m.fire[0, 3] > 0.25
    assert m.correlation[0, 4] > 0.9 and m.weight[0] < 0.7 < m.weight[2]
    assert ((m.posterior(votes.astype(float), 1.0) > 0.5) == y).mean() > 0.96


def brute_quality(rows, marks):
    """Scores of every text by dense algebra over the whole table at once."""
    x = np.array([stats(t) for _, t, _ in rows])
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    part = {i: zlib.crc32(str(i).encode()) % 5 for i, _, _ in rows}
    known = {i: q for i, q, _ in marks if not held(i)}
    at = [k for k, (i, _, _) in enumerate(rows) if i in known]
    z = quality.fourier(x, mean, scale)
    y = np.array([known[rows[k][0]] for k in at], float)
    last = np.array([part[rows[k][0]] == 4 for k in at])
    zf, yf = z[at][~last], y[~last]
    a = zf.T @ zf
    penalty = quality.RIDGE * len(zf) / quality.FEATURES * np.eye(len(a))
    penalty[-1, -1] = 0
    raw = z @ np.linalg.lstsq(a + penalty, zf.T @ yf, rcond=None)[0]
    own, target = raw[at][last], y[last]
    box = np.floor((np.clip(own, -0.5, 1.5) + 0.5) * (quality.BINS / 2)).astype(int)
    bins = sorted(set(box.tolist()))
    knots = np.array([own[box == b].mean() for b in bins])
    w = np.array([(box == b).sum() for b in bins], float)
    share = np.array([target[box == b].mean() for b in bins])
    smooth = (share * w + target.mean() * 0.5) / (w + 0.5)
    # The isotonic fit as the greatest mean from the left of the least mean to the right.
    rising = [max(min(np.average(smooth[lo : hi + 1], weights=w[lo : hi + 1]) for hi in range(k, len(w))) for lo in range(k + 1)) for k in range(len(w))]
    return np.clip(np.interp(raw, knots, rising), 0, 1)


def test_quality_matches_brute_force(spark):
    rows, marks = corpus(300)
    got = {r.doc_id: r.score for r in quality.classify(docs(spark, rows), labels(spark, marks)).collect()}
    want = brute_quality(rows, marks)
    assert np.allclose([got[i] for i, _, _ in rows], want, atol=1e-6)


def brute_vocabulary(rows, marks):
    known = {i: t for i, _, t in marks if not held(i)}
    groups: dict = {}
    for i, text, _ in rows:
        words = toxicity.words_of(text) if i in known else set()
        if words:
            least = min(toxicity.xxhash.xxh64_intdigest(w) for w in words) >> 16
            for w in words:
                for x in toxicity.tokens(w):
                    own = groups.setdefault(x, (set(), set(), set()))
                    own[known[i]].add(least)
                    if known[i]:
                        own[2].add(w)
    base = sum(known.values()) / len(known)
    kept = []
    for x, (clean, toxic, words) in groups.items():
        if len(toxic) >= toxicity.MIN_GROUPS and len(toxic) >= toxicity.MIN_SHARE * (len(toxic) + len(clean)) and (not x.endswith("*") or len(words) >= toxicity.MIN_WORDS):
            if toxicity.chance(len(toxic), len(toxic) + len(clean), base) < toxicity.MAX_CHANCE:
                kept.append(x)
    return sorted(kept), base


def test_toxicity_matches_brute_force(spark):
    rows, marks = corpus(300)
    vocabulary, prior = brute_vocabulary(rows, marks)
    assert toxicity.induce(docs(spark, rows).coalesce(1).select("doc_id", "text"), labels(spark, marks), "toxic") == (vocabulary, prior)
    reader = toxicity.Reader(vocabulary)
    read = [reader.read(t) for _, t, _ in rows]
    pattern, n = np.unique([p for p, _ in read], return_counts=True)
    model = label_model.fit(pattern, n, toxicity.VOTERS, prior)
    extra = [[*h, *(len(vocabulary) + k for k in range(len(toxicity.LEXICONS)) if p >> k & 1)] for p, h in read]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0], read[k][0], read[k][1]))
    target = model.posterior(label_model.unpack(np.array([read[k][0] for k in order]), toxicity.VOTERS))
    weights, bias = toxicity.train_logistic([extra[k] for k in order], target, len(vocabulary) + len(toxicity.LEXICONS))
    want = [1 / (1 + np.exp(-np.clip(bias + weights[e].sum(), -50, 50))) for e in extra]
    got = {r.doc_id: r.score for r in toxicity.classify(docs(spark, rows).coalesce(1), labels(spark, marks)).collect()}
    assert np.allclose([got[i] for i, _, _ in rows], want, atol=1e-6)
