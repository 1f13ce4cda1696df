import hashlib
import itertools
import random
import struct

from strandlake.llm import piece_coding as pc
from strandlake.llm import piece_lattice as pl
from strandlake.llm.registry import tokenizer_file

from tests.llm.helpers import awkward, docs

PATH = tokenizer_file("piece_bpe_32k.model")


def paths(edges, i=0):
    """All paths as (score, ids, piece lengths)."""
    if i == len(edges):
        yield 0, (), ()
        return
    for j, s, ids in edges[i]:
        for a, b, c in paths(edges, j):
            yield a + s, ids + b, (i - j, *c)


def test_a_star_gives_the_n_best_in_order():
    pieces = pl.Pieces(PATH)
    random.seed(1)
    units = [" the", "\n", "  ", " a", "é", "梦", " ing", " thanedb", "▁"] + [" " + "".join(random.choice("abcdeéñ.ing") for _ in range(6)) for _ in range(80)]
    for u in units:
        e = pieces.edges(u)
        every = sorted(paths(e), key=lambda p: (-p[0], p[2][::-1]))
        assert pl.n_best(e, 6) == [p[:2] for p in every[:6]]
        best, (margin,), ids = pl.viterbi(e)
        assert (best[-1], ids) == every[0][:2] and (margin == every[0][0] - every[1][0] if len(every) > 1 else margin > 1 << 58)


def test_whole_texts_match_brute_force():
    s = pl.Segmenter(PATH, store=3)
    for text in ["a bc", "the cat", "x\ny", "  ", "", "é ñ", "ab\n\nc"]:
        e = s.pieces.edges(" " + text)
        every = sorted((p[0] for p in paths(e)), reverse=True)[:4]
        units, scores, changes = s.segment(text)
        assert scores == every
        for score, c in zip(scores, changes):
            ids = b"".join(c.get(k, u) for k, u in enumerate(units))
            assert s.decode(ids) == text
            assert score in {p[0] for p in paths(e) if struct.pack(f"<{len(p[1])}H", *p[1]) == ids}


def test_every_text_comes_back(spark):
    rows = awkward() + [(50, "▁a ▁▁ b", "s"), (51, " lead and trail ", "s"), (52, "\r\n\t\x00\x1f", "s")]
    coded = pc.encode(docs(spark, rows), PATH)
    back = pc.decode(coded, PATH).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(i), t or "") for i, t, _ in rows)
    coder = pl.segmenter(PATH)
    assert all(coder.decode(bytes(o)) == r.text for r in back for o in r.others)
    report = pc.code_report(docs(spark, rows), PATH).collect()
    assert all(r.round_trip for r in report)
    assert sorted((str(r.doc_id), r.decoded_sha256) for r in report) == sorted((str(i), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in rows)
    assert sorted((str(r.doc_id), bytes(r.best)) for r in coded.collect()) == sorted((str(i), b"".join(coder.segment(t or "")[0])) for i, t, _ in rows)
    assert pc.code_report(docs(spark, []), PATH).collect() == []


def test_stores_do_not_change_results():
    random.seed(8)
    texts = [" ".join("".join(random.choice("abcd") for _ in range(4)) for _ in range(30)) for _ in range(20)]
    small, large = pl.Segmenter(PATH, store=5), pl.Segmenter(PATH)
    for t in itertools.chain(texts, texts):
        assert small.segment(t) == large.segment(t)


def k_best(pieces, text, n):
    """Scores of the N best of a whole text, every start and end tried: lists of the N best up to each node."""
    known = {d.decode(): i for i, d in enumerate(pieces.data) if i not in pieces.byte_ids and d}
    longest, up_to = max(map(len, known)), [[0]]
    scores = {}
    for i, own in enumerate(pieces.edges(text)):
        for end, s, _ in own:
            scores[i, end] = s
            assert end == i + 1 or text[i:end] in known
    for j in range(1, len(text) + 1):
        every = [v + scores[i, j] for i in range(max(0, j - longest), j) if (i, j) in scores for v in up_to[i]]
        up_to.append(sorted(every, reverse=True)[:n])
    return up_to[-1]


def test_long_units_are_solved_whole():
    rng = random.Random(6)
    s = pl.Segmenter(PATH)
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4100)), "".join(rng.choice("梦语言中文的是在") for _ in range(2500)), "x" * 4001, "ab" * 1500 + "!" * 2100]
    for text in [*texts, "then " + texts[0] + " and\n" + texts[1] + " end"]:
        units, scores, changes = s.segment(text)
        assert scores == k_best(s.pieces, " " + text, 4)
        for score, c in zip(scores, changes):
            ids = b"".join(c.get(k, u) for k, u in enumerate(units))
            assert s.decode(ids) == text
            worth = {i: v for i, v in weights(s.pieces)}
            assert sum(worth[i] for (i,) in struct.iter_unpack("<H", ids)) == score
    assert max(map(len, s.new)) <= pl.LONGEST_KEPT


def weights(pieces):
    yield from ((i, pieces.floor) for i in pieces.byte_ids)
    work = list(pieces.tree.values())
    while work:
        below, value, i = work.pop()
        work.extend(below.values())
        if value is not None:
            yield i, value
