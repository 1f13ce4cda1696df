"""Operator 2, toxicity by weak supervision.

Voters are fixed lexicons, patterns, and lexicons induced from labelled rows
that are not held out. A generative label model over the vote patterns of all
documents gives posterior labels, and a logistic regression over the words and
word beginnings of the induced vocabulary is trained on them.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm import label_model
from strandlake.llm.common import cut, held_out, map_arrow, packed

# Lexicons of insults, one voter each.
LEXICONS = {
    "insults_of_wit": "idiot idiots moron morons stupid dumb dumbass imbecile retard",
    "insults_of_worth": "loser losers worthless pathetic useless scum trash garbage",
    "insults_of_ridicule": "clown clowns disgusting ugly filthy vermin freak creep",
    "insults_de": "arschloch idiotin dummkopf trottel abschaum schwachkopf miststück",
    "insults_fr": "connard connasse imbécile crétin abruti salaud ordure",
    "insults_es": "imbécil estúpido idiota basura cabrón pendejo escoria",
}
LEXICON_OF = {w: i for i, words in enumerate(LEXICONS.values()) for w in words.split()}

# Pattern voters.
PATTERNS = {
    "address": re.compile(r"\byou(?: are|'re| r)?(?: an?| such an?)? (?:idiot|moron|loser|clown|stupid|pathetic|worthless|disgusting|trash|scum)\b", re.I),
    "spelled_round": re.compile(r"\b(?:1d[i1]ot|id10t|m0ron|st[u*]p[1!*]d|l0ser|[s$]cum|tr[@4]sh)\b", re.I),
}

#: Induced voters: the vocabulary is dealt to them by its own hash.
INDUCED = 6
VOTERS = len(LEXICONS) + len(PATTERNS) + INDUCED

#: Labelled rows of each class read for the induced vocabulary, on average where there are more.
FIT_ROWS = 6000
#: Documents that train the classifier on posterior labels, on average where there are more: half with votes, half without.
TRAIN_ROWS = 20_000
#: A word or beginning is induced when this many distinct groups of alike texts hold it and this share of them is toxic.
MIN_GROUPS = 3
#: ... and when chance alone gives so many toxic groups with less than this probability.
MAX_CHANCE = 1e-5
MIN_SHARE = 0.85
MIN_WORDS = 3
PREFIXES = (4, 5, 6, 7, 8)
L2 = 1e-3

WORD = re.compile(r"[^\W\d_]+")


def tokens(word: str) -> list[str]:
    """A word and its beginnings (marked by a star), which a vocabulary may hold."""
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) > k)]


def words_of(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def _known(labels: DataFrame, label_col: str) -> DataFrame:
    rows = labels.where(F.col(label_col).isin(0, 1) & ~held_out("doc_id"))
    return rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label_col).cast("int").alias("y"))


def induce(docs: DataFrame, labels: DataFrame, label_col: str) -> tuple[list[str], float]:
    """Vocabulary of words and beginnings that mark toxic texts, and the share of toxic labels.

    Reads about FIT_ROWS labelled rows of each class, picked by the hash of their
    id, or all if there are fewer; the vocabulary is theirs, so it is bounded too. Texts with the same least word hash count once, so copies do
    not make a rare word look common.
    """
    known = _known(labels, label_col)
    share = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picked = known.where(F.when(F.col("y") == 1, _picked(FIT_ROWS, share.get(1, 0), 1)).otherwise(_picked(FIT_ROWS, share.get(0, 0), 1)))
    rows = docs.join(F.broadcast(picked), "doc_id").select("text", "y")

    def run(batches):
        seen: dict[str, tuple[set, set, set]] = defaultdict(lambda: (set(), set(), set()))
        for b in batches:
            for t, y in zip(b.column(0), b.column(1)):
                words, toxic = words_of(t.as_py() or ""), y.as_py()
                if not words:
                    continue
                group = min(xxhash.xxh64_intdigest(w) for w in words) >> 16
                for w in words:
                    for x in tokens(w):
                        own = seen[x]
                        own[toxic].add(group)
                        if toxic and len(own[2]) < MIN_WORDS:
                            own[2].add(w)
        got = [(x, sorted(c), sorted(t), sorted(w)) for x, (c, t, w) in seen.items() if t]
        ids, text = pa.list_(pa.int64()), pa.list_(pa.string())
        clean = [(x, len(c)) for x, (c, t, _) in seen.items() if not t]
        yield pa.RecordBatch.from_arrays(
            [pa.array([g[0] for g in got] + [c[0] for c in clean]), pa.array([len(g[1]) for g in got] + [c[1] for c in clean], pa.int64()), pa.array([g[2] for g in got] + [[] for _ in clean], ids), pa.array([g[3] for g in got] + [[] for _ in clean], text)],
            ["token", "clean", "toxic", "words"],
        )

    found = map_arrow(rows, run, "token string, clean long, toxic array<long>, words array<string>")
    per = found.groupBy("token").agg(
        F.sum("clean").alias("clean"), F.size(F.array_distinct(F.flatten(F.collect_list("toxic")))).alias("toxic"), F.size(F.array_distinct(F.flatten(F.collect_list("words")))).alias("words")
    )
    strong = per.where((F.col("toxic") >= MIN_GROUPS) & (F.col("toxic") >= MIN_SHARE * (F.col("toxic") + F.col("clean"))))
    strong = strong.where(~F.col("token").endswith("*") | (F.col("words") >= MIN_WORDS))
    found = sorted(strong.select("token", "toxic", "clean").collect())
    total = sum(share.values())
    base = min(share.get(1, 0), FIT_ROWS) / max(1, sum(min(n, FIT_ROWS) for n in share.values()))
    kept = [r.token for r in found if chance(r.toxic, r.toxic + r.clean, base) < MAX_CHANCE]
    return kept, share.get(1, 0) / total if total else 0.05


def _picked(wanted: int, n: int, salt: int) -> Column:
    """True for about ``wanted`` of ``n`` rows, by the hash of their id; for all if there are no more."""
    if n <= wanted:
        return F.lit(True)
    return F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1 << 30)) < int(wanted / n * (1 << 30))


def chance(toxic: int, n: int, base: float) -> float:
    """P(at least ``toxic`` of ``n`` groups are toxic) when each is with probability ``base``."""
    return sum(math.comb(n, k) * base**k * (1 - base) ** (n - k) for k in range(toxic, n + 1))


class Reader:
    """Vote pattern and vocabulary hits of one text; what a word gives is kept."""

    def __init__(self, vocabulary: Iterable[str], store: int = 300_000):
        self.at = {x: i for i, x in enumerate(vocabulary)}
        first = len(LEXICONS) + len(PATTERNS)
        self.bit = {i: first + xxhash.xxh32_intdigest(x) % INDUCED for x, i in self.at.items()}
        self.known: dict[str, tuple] = {}
        self.store = store

    def of_word(self, w: str) -> tuple:
        hits = tuple(i for x in tokens(w) if (i := self.at.get(x)) is not None)
        bits = 0
        if w in LEXICON_OF:
            bits |= 1 << LEXICON_OF[w]
        for i in hits:
            bits |= 1 << self.bit[i]
        if len(self.known) >= self.store:
            self.known.clear()
        self.known[w] = out = (bits, hits) if bits or hits else None
        return out

    def read(self, text: str) -> tuple[int, list[int]]:
        pattern, hits = 0, set()
        known = self.known
        for w in words_of(text):
            got = known[w] if w in known else self.of_word(w)
            if got:
                pattern |= got[0]
                hits.update(got[1])
        if pattern:
            for k, p in enumerate(PATTERNS.values(), len(LEXICONS)):
                if p.search(text):
                    pattern |= 1 << k
        elif PATTERNS["spelled_round"].search(text):
            pattern |= 1 << (len(LEXICONS) + 1)
        return pattern, sorted(hits)


def train_logistic(rows: list[list[int]], target: np.ndarray, size: int, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression on sparse 0/1 rows with soft targets, by accelerated gradient steps."""
    n = len(rows)
    at = np.repeat(np.arange(n), [len(r) for r in rows])
    col = np.fromiter((i for r in rows for i in r), np.int64, len(at))
    w, b = np.zeros(size), float(np.log(max(target.mean(), 1e-4) / max(1 - target.mean(), 1e-4)))
    vw, vb, step = w.copy(), b, 4.0 / max(1.0, np.bincount(at, minlength=1).mean() if len(at) else 1.0)
    for k in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(at, vw[col], n) + vb, -50, 50)))
        g = p - target
        nw = vw - step * (np.bincount(col, g[at], size) / n + L2 / n * vw)
        nb = vb - 0.5 * g.mean()
        f = k / (k + 3)
        vw, vb = nw + f * (nw - w), nb + f * (nb - b)
        w, b = nw, nb
    return w, b


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (doc_id, held_out, score, predicted, posterior) per row of ``docs``.

    score is the classifier's probability of label 1, posterior the label
    model's. Null and empty texts score by the classifier's constant; repeated
    rows come out as often as they come in; null ids are scored and not held
    out; no rows give none. Without labels the fixed voters alone are used.
    """
    rows = packed(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    vocabulary, prior = induce(rows, labels, label_col)

    def run(batches):
        reader = Reader(vocabulary)
        for b in batches:
            got = [reader.read(t.as_py() or "") for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([p for p, _ in got], pa.int64()), pa.array([h for _, h in got], pa.list_(pa.int32()))], ["doc_id", "pattern", "hits"]
            )

    table = cut(map_arrow(rows, run, "doc_id long, pattern long, hits array<int>"))
    counts = table.groupBy("pattern").agg(F.count("*").alias("n")).collect()
    pattern, n = np.array([r.pattern for r in counts], np.int64), np.array([r.n for r in counts], np.int64)
    voters = label_model.fit(pattern, n, VOTERS, prior) if counts else None

    size = len(vocabulary) + len(LEXICONS)
    fixed = (1 << len(LEXICONS)) - 1
    extra = lambda p, h: [*h, *(len(vocabulary) + k for k in range(len(LEXICONS)) if (p & fixed) >> k & 1)]
    weights, bias = np.zeros(size), -3.0
    if counts:
        silent = int(n[pattern == 0].sum())
        half = TRAIN_ROWS // 2
        sampled = F.when(F.col("pattern") == 0, _picked(half, silent, 7)).otherwise(_picked(half, int(n.sum()) - silent, 7))
        picked = sorted(table.where(sampled).select("doc_id", "pattern", "hits").collect(), key=lambda r: (r.doc_id is None, r.doc_id, r.pattern, r.hits))
        target = voters.posterior(label_model.unpack(np.array([r.pattern for r in picked], np.int64), VOTERS))
        weights, bias = train_logistic([extra(r.pattern, r.hits) for r in picked], target, size)

    def score(batches):
        for b in batches:
            p = b.column(1).to_numpy()
            logit = np.array([bias + weights[extra(x, h)].sum() for x, h in zip(p.tolist(), b.column(2).to_pylist())], np.float64)
            post = voters.posterior(label_model.unpack(p, VOTERS))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(logit, -50, 50)))), pa.array(post)], ["doc_id", "score", "posterior"])

    scored = map_arrow(table, score, "doc_id long, score double, posterior double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "posterior")
