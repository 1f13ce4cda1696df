import numpy as np
from strandlake.llm import anisotropic as aq
from strandlake.llm import vector_search as vs

SCHEMA = "vec_id long, embedding array<float>, v string, codes string, block string, chunk string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if x is None else [None if y is None else float(y) for y in x], *["c"] * 4) for i, x in rows], SCHEMA)


def brute(rows, k=20):
    good = {}
    for i, x in rows:
        if i is None or x is None or any(y is None or not np.isfinite(y) for y in x) or not any(x):
            continue
        x = np.array(x, np.float32).astype(np.float64).tolist()
        good[i] = min(good.get(i, x), x)
    out = {}
    for q in good:
        if q % 20 == 0:
            got = sorted(((-float((np.array(good[q]) * np.array(x)).sum()), i) for i, x in good.items() if i != q))[:k]
            out[q] = [(i, -s) for s, i in got]
    return out


def test_recall_and_exact_scores(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 32))
    x[500:700] = x[500] + rng.normal(0, 1e-3, (200, 32))  # a crowd of near copies
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    monkeypatch.setattr(vs, "BLOCK", 200)
    monkeypatch.setattr(vs, "SHARDS", 3)
    monkeypatch.setattr(vs, "CHUNK", 30)
    got = vs.search(table(spark, rows)).collect()
    want = brute(rows)
    found: dict = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(found) == set(want) and all(len(v) == 20 for v in found.values())
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)
    exact = np.array(x, np.float32).astype(np.float64)
    assert all(s == float((exact[q] * exact[i]).sum()) for q, v in found.items() for i, s in v)
    assert all([(-s, i) for i, s in v] == sorted((-s, i) for i, s in v) for v in found.values())


def test_crowds_of_copies_and_near_copies():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6 * vs.BLOCK, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.arange(len(x))
    for noise in (0.0, 1e-3):
        crowd = rng.permutation(len(x))[: len(x) // 3]
        x[crowd] = x[crowd[0]] + rng.normal(0, 1, (len(crowd), 64)) * noise
        books = aq.fit(x[: vs.FIT_ROWS])
        codes = [c.tobytes() for c in aq.pack(aq.assign(x, books, aq.eta_of(64)))]
        near = vs.Nearest(books, vs.NEIGHBOURS)
        asked = ids[::20]
        near.ask(asked, x[asked])
        # Blocks from the last to the first: later blocks hold the smaller ids.
        for k in reversed(range(0, len(x), vs.BLOCK)):
            near.offer(ids[k : k + vs.BLOCK], x[k : k + vs.BLOCK], codes[k : k + vs.BLOCK])
        got: dict = {}
        for r in near.found().to_pylist():
            got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        for q in asked.tolist():
            scores = (x * x[q]).sum(axis=1)
            scores[q] = -np.inf
            assert got[q] == [(i, scores[i]) for i in np.lexsort((ids, -scores))[: vs.NEIGHBOURS].tolist()]


def test_awkward_vectors(spark):
    rows = [(0, [1, 0, 0]), (20, [0, 1, 0]), (40, [0, 0, 0]), (60, None), (80, [1, None, 0]), (100, [float("nan"), 0, 1]), (120, [float("inf"), 0, 1]), (140, [1, 2]), (160, []), (None, [1, 1, 1])]
    rows += [(1, [1, 1, 0]), (2, [1, 1, 0]), (3, [1, 1, 0]), (3, [1, 1, 0]), (-20, [2, 0, 0]), (5, [-1, -1, -1])]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in vs.search(table(spark, rows)).collect())
    fit = [r for r in rows if r[1] is None or len(r[1]) == 3]
    assert got == sorted((q, n, i, s) for q, v in brute(fit).items() for n, (i, s) in enumerate(v, 1))
    assert vs.search(table(spark, [])).collect() == []
    assert vs.search(table(spark, [(0, [1.0])])).collect() == []


def test_anisotropic_loss_is_lower_than_plain_quantisation():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(800, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    eta = 4.0
    books = aq.fit(x)
    at = np.arange(len(books))

    def loss(codes):
        e = x - books[at, codes].reshape(len(x), -1)
        return ((e * e).sum(1) + (eta - 1) * (e * x).sum(1) ** 2).mean()

    assert loss(aq.assign(x, books, eta)) < loss(aq.assign(x, books, 1.0))
    codes = aq.assign(x, books, eta)
    near = aq.scan(aq.pack(codes), aq.tables(x[:5], books))
    assert np.allclose(near, x[:5] @ books[at, codes].reshape(len(x), -1).T, atol=1e-5)
