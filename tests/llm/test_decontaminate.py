import random
from collections import Counter, defaultdict

from strandlake.llm import bm25_wand as bw
from strandlake.llm import decontaminate as dc

from tests.llm.helpers import awkward, docs


def words(n, rng, size=60):
    return [f"w{min(int(rng.paretovariate(0.6)), size)}" for _ in range(n)]


def bench(spark, rows):
    return spark.createDataFrame([(*r, "k", "s") for r in rows], "item_id long, text string, key string, source string")


def brute(text, items):
    own = bw.words_of(text or "")
    have = bw.shingles(own) | {tuple(own[i : i + n]) for n in range(1, 5) for i in range(len(own) - n + 1)}
    out = set()
    for i, t in items:
        q, a = (bw.shingles(bw.words_of(x)) for x in bw.split_item(t or ""))
        if (q or a) and all(not s or len(s & have) >= 0.8 * len(s) for s in (q, a)):
            out.add(i)
    return out


def test_wand_retrieves_all_above_the_threshold():
    rng = random.Random(4)
    items = [bw.Item(i, *bw.split_item(t), t) for i, t in enumerate(" ".join(words(rng.randint(3, 40), rng)) + "." for _ in range(150))]
    df = Counter(t for i in items for t in set(i.words))
    ix = bw.Index(items, len(items), sum(len(i.words) for i in items) / len(items), df, {f"w{k}": 1000 - k for k in range(60)})
    for _ in range(300):
        passage = set(words(rng.randint(1, 60), rng)) | set(rng.choice(items).words)
        total = defaultdict(float)
        for t in passage & set(ix.postings):
            for k, w in zip(*ix.postings[t]):
                total[k] += w
        want = {k for k, s in total.items() if s >= 1 - 1e-12}
        assert {k for k, _ in ix.retrieve(passage)} == want
        hits = ix.essential & passage
        assert not want or hits and ix.may_reach(hits)


def test_documents_match_brute_force(spark):
    rng = random.Random(9)
    items = [(i, " ".join(words(rng.randint(12, 50), rng, 900)) + ". " + " ".join(f"x{i}y{k}" for k in range(rng.randint(2, 12))) + ".") for i in range(40)]
    items += [(100, None), (101, ""), (102, "..."), (7, items[7][1]), (103, "short one"), (104, "two words. yes")]
    rows = [(1000 + d, " ".join(words(rng.randint(0, 600), rng, 900)), "s") for d in range(60)]
    for d in range(40):
        own = words(rng.randint(0, 500), rng, 900)
        at = rng.randint(0, len(own))
        leak = items[d][1].replace(".", "").split()
        if d % 4 == 1:
            leak[-1] = "changed"
        if d % 4 == 2:
            leak = leak[: len(leak) // 2]
        rows.append((2000 + d, " ".join([*own[:at], *leak, *own[at:]]), "s"))
    rows += awkward() + [(2000, rows[60][1], "s")]
    got = Counter((r.doc_id, r.item_id) for r in dc.contaminated(docs(spark, rows), bench(spark, items)).collect())
    want = Counter((i, x) for i, t, _ in rows for x in brute(t, [p for p in dict(items).items()]))
    assert set(got) == set(want) and len(want) >= 20
    kept = Counter(str(r.doc_id) for r in dc.drop_contaminated(docs(spark, rows), bench(spark, items)).collect())
    assert kept == Counter(str(i) for i, t, _ in rows if not brute(t, items))


def test_many_indexes_and_empty_tables(spark, monkeypatch):
    items = [(i, f"alpha{i} beta{i} gamma{i} delta{i} eps{i} zeta{i} eta{i}. theta{i} iota{i}.") for i in range(7)]
    table = docs(spark, [(i, "so " + t.lower() + " then", "s") for i, t in items])
    whole = sorted((r.doc_id, r.item_id) for r in dc.contaminated(table, bench(spark, items)).collect())
    monkeypatch.setattr(dc, "INDEX_ITEMS", 3)
    assert sorted((r.doc_id, r.item_id) for r in dc.contaminated(table, bench(spark, items)).collect()) == whole == [(i, i) for i in range(7)]
    assert dc.contaminated(docs(spark, []), bench(spark, items)).collect() == []
    assert dc.contaminated(table, bench(spark, [])).collect() == []
    assert dc.drop_contaminated(table, bench(spark, [])).count() == 7


def test_passes_over_many_indexes(spark, monkeypatch):
    items = [(i, f"alpha{i} beta{i} gamma{i} delta{i} eps{i} zeta{i} eta{i}. theta{i} iota{i}.") for i in range(7)]
    rows = [(i, "so " + t.lower() + " then", "s") for i, t in items] + [(20, "clean words only here", "s"), (21, None, "s"), (None, items[3][1], "s")]
    monkeypatch.setattr(dc, "INDEX_ITEMS", 2)
    monkeypatch.setattr(dc, "INDEXES_A_PASS", 1)
    assert len(dc._passes(docs(spark, rows), bench(spark, items))) == 4
    assert sorted((str(r.doc_id), r.item_id) for r in dc.contaminated(docs(spark, rows), bench(spark, items)).collect()) == sorted([*((str(i), i) for i in range(7)), ("None", 3)])
    assert sorted(r.doc_id for r in dc.drop_contaminated(docs(spark, rows), bench(spark, items)).collect()) == [20, 21]
