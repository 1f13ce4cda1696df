import random

import numpy as np
import pytest
import xxhash
from strandlake.llm import simhash_dedup as sd
from strandlake.llm.components import connected_components
from strandlake.llm.fingerprints import simhash

from tests.llm.helpers import awkward, docs


def brute_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(pairs):
    """pairs: (id, fingerprint)."""
    got = {}
    for i, f in pairs:
        seen, work = {f}, [f]
        while work:
            x = work.pop()
            for _, g in pairs:
                if g not in seen and (x ^ g).bit_count() <= 3:
                    seen.add(g)
                    work.append(g)
        ids = [j for j, g in pairs if g in seen and j is not None]
        got[f] = min(ids, default=None)
    return got


def test_fingerprints_match_brute_force():
    random.seed(1)
    texts = [t for _, t, _ in awkward()] + [" ".join(random.choice("ab Ab c é".split(" ")) for _ in range(n)) for n in range(40)]
    for t in texts:
        assert simhash((t or "").encode()) == brute_fingerprint(t)


def test_awkward_documents(spark):
    rows = awkward()
    got = sd.simhash_components(docs(spark, rows)).collect()
    want = brute_components([(i, brute_fingerprint(t)) for i, t, _ in rows if i is not None])
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.fingerprint, r.component_id) for r in got) == sorted(
        (i is not None, i or 0, f"{(f := brute_fingerprint(t)):016x}", want.get(f)) for i, t, _ in rows
    )


def test_no_documents(spark):
    assert sd.simhash_components(docs(spark, [])).collect() == []
    assert sd.keep_one_per_group(docs(spark, [])).collect() == []


@pytest.mark.parametrize("limit", [2, 3, 256])
def test_links_at_every_posting_limit(spark, limit):
    """Chains of fingerprints one to four bits apart, in dense groups that share most bytes."""
    random.seed(7)
    fps = set()
    for _ in range(6):
        f = random.getrandbits(64)
        for _ in range(25):
            fps.add(f)
            for b in random.sample(range(64), random.randint(1, 4)):
                f ^= 1 << b
    fps = sorted(fps)
    nodes = spark.createDataFrame([(sd._signed(f), i) for i, f in enumerate(fps)], "fp long, m long")
    comp = {r.node: r.component for r in connected_components(sd.links(nodes, limit)).collect()}
    want = brute_components(list(enumerate(fps)))
    assert all(comp.get(i, i) == want[f] for i, f in enumerate(fps))


def test_components_of_a_long_chain_and_a_hub(spark):
    links = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[1000 + i] == 1000 for i in range(300))


def test_one_of_each_group_stays(spark):
    rows = [(5, "a b c d e f", "x"), (2, "A B C D E F", "y"), (9, "quite other words are in here", "x"), (2, "A B C D E F", "y"), (None, "a b c d e f", "x")]
    kept = sd.keep_one_per_group(docs(spark, rows)).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["2", "9", "None"]
    assert np.array_equal(sorted(sd.keep_one_per_group(docs(spark, rows)).columns), sorted(docs(spark, rows).columns))


def test_unlike_texts_of_one_id_are_all_kept(spark):
    a, b, c = "one two three four five", "quite another text than that", "and a third one of its own"
    rows = [(2, a, "x"), (5, a, "x"), (5, b, "x"), (5, c, "x"), (5, c, "x"), (7, c, "y"), (8, None, "x"), (9, "", "x"), (8, None, "x")]
    kept = sd.keep_one_per_group(docs(spark, rows)).collect()
    assert sorted((r.doc_id, r.text or "") for r in kept) == sorted([(2, a), (5, b), (5, c), (8, "")])
    got = {(r.doc_id, r.fingerprint): r.component_id for r in sd.simhash_components(docs(spark, rows)).collect()}
    assert got[5, f"{brute_fingerprint(a):016x}"] == 2 and got[7, f"{brute_fingerprint(c):016x}"] == 5 and got[9, "0" * 16] == 8


def test_more_rows_than_a_broadcast_holds(spark, monkeypatch):
    rows = [(i, f"text number {i % 7} of the group {i % 7}", "x") for i in range(60)] + [(1, "text number 1 of the group 1", "x")]
    shown = lambda: sorted(map(str, sd.keep_one_per_group(docs(spark, rows)).collect()))
    few = shown()
    monkeypatch.setattr(sd, "bounded", lambda df: df)
    assert shown() == few and len(few) == 7
