"""BM25 inverted index of test items with block-max WAND retrieval above a threshold.

An item's impacts are divided by the least score that a passage holding it must
reach, so one threshold, 1, serves all items. Before the index is walked a
passage must pass a gate: no item reaches the threshold from common terms
alone, so some item must get what it still needs from the passage's essential
terms. The gate never turns away a passage that WAND would answer.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\W_]+")
K1, B = 1.2, 0.75
BLOCK = 32
#: Share of the threshold that common terms may give an item; the least sum that counts as reaching 1.
COMMON = 0.8
REACH = 1 - 1e-9
SHINGLE = 5
OVERLAP = 0.8
SENTENCE = re.compile(r"(?<=[.!?])\s+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def shingles(words: list[str]) -> set[tuple[str, ...]]:
    """Five-word shingles; fewer words make one of the whole sequence, none make none."""
    if len(words) <= SHINGLE:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(SHINGLE))))


def split_item(text: str) -> tuple[str, str]:
    """(question, answer): the last sentence is the answer; one sentence alone is both."""
    parts = [p for p in SENTENCE.split(text.strip()) if words_of(p)]
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text, text)


class Item:
    __slots__ = ("item_id", "words", "question", "answer")

    def __init__(self, item_id, question: str, answer: str, text: str):
        self.item_id, self.words = item_id, words_of(text)
        self.question, self.answer = shingles(words_of(question)), shingles(words_of(answer))


class Index:
    """Postings (item, impact) of each term by item number, with the largest impact of each block."""

    def __init__(self, items: list[Item], n_items: int, mean_words: float, df: dict[str, int], seen_often: dict[str, int] | None = None):
        self.items = items
        self.longest = max((len(i.words) for i in items), default=0)
        self.postings: dict[str, tuple[list[int], list[float]]] = {}
        self.block_max: dict[str, list[float]] = {}
        raw: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for k, item in enumerate(items):
            tf, n = Counter(item.words), len(item.words)
            own = {}
            for t, f in tf.items():
                idf = math.log(1 + (n_items - df[t] + 0.5) / (df[t] + 0.5))
                own[t] = idf * f * (K1 + 1) / (f + K1 * (1 - B + B * n / mean_words))
            # Missing one in five shingles leaves at most so many words unseen; the dearest may be those.
            unseen = math.ceil((1 - OVERLAP) * max(1, n - SHINGLE + 1)) + 1
            dearest = sorted((own[t] for t in item.words), reverse=True)[:unseen]
            least = max(sum(own.values()) - sum(dearest), min(own.values(), default=1.0), 1e-9)
            for t, w in own.items():
                raw[t].append((k, w / least))
        for t, p in raw.items():
            self.postings[t] = ([k for k, _ in p], [w for _, w in p])
            self.block_max[t] = [max(w for _, w in p[i : i + BLOCK]) for i in range(0, len(p), BLOCK)]
        self.top = {t: max(b) for t, b in self.block_max.items()}
        self.gate = self._gate(seen_often or {})
        self.essential = frozenset(self.gate)
        self.gate_top = {t: max(w for _, w in p) for t, p in self.gate.items()}

    def _gate(self, seen_often: dict[str, int]) -> dict[str, list[tuple[int, float]]]:
        """Essential terms with (item, share of what the item still needs beyond its common terms).

        Terms are taken as common by falling frequency in ``seen_often`` while no
        item gets more than COMMON of the threshold from them. The order changes
        the work only, never what passes.
        """
        total = [0.0] * len(self.items)
        essential = []
        for t in sorted(self.postings, key=lambda t: (-seen_often.get(t, 0), -len(self.postings[t][0]), t)):
            ks, ws = self.postings[t]
            if all(total[k] + w < COMMON for k, w in zip(ks, ws)):
                for k, w in zip(ks, ws):
                    total[k] += w
            else:
                essential.append(t)
        return {t: [(k, w / (1 - total[k])) for k, w in zip(*self.postings[t])] for t in essential}

    def may_reach(self, hits: set[str]) -> bool:
        """False if no item can score 1 in a passage whose essential terms are ``hits``."""
        if sum(map(self.gate_top.__getitem__, hits)) < REACH:
            return False
        got: dict[int, float] = defaultdict(float)
        for t in hits:
            for k, w in self.gate[t]:
                got[k] += w
        return max(got.values()) >= REACH

    def retrieve(self, terms: set[str]) -> list[tuple[int, float]]:
        """(item number, score) of all items that score 1 or more for a passage's ``terms``, by block-max WAND."""
        cursors = [[self.postings[t][0], self.postings[t][1], self.block_max[t], self.top[t], 0] for t in terms if t in self.postings]
        found = []
        while cursors:
            cursors.sort(key=lambda c: c[0][c[4]])
            bound, pivot = 0.0, -1
            for i, c in enumerate(cursors):
                bound += c[3]
                if bound >= REACH:
                    pivot = i
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0][cursors[pivot][4]]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0][cursors[pivot + 1][4]] == item:
                pivot += 1
            ahead = cursors[: pivot + 1]
            for c in ahead:
                self._seek(c, item)
            near = sum(c[2][c[4] // BLOCK] for c in ahead if c[4] < len(c[0]))
            if near >= REACH:
                score = 0.0
                for c in ahead:
                    if c[4] < len(c[0]) and c[0][c[4]] == item:
                        score += c[1][c[4]]
                        c[4] += 1
                if score >= REACH:
                    found.append((item, score))
            else:
                ends = [c[0][min(len(c[0]), (c[4] // BLOCK + 1) * BLOCK) - 1] for c in ahead if c[4] < len(c[0])]
                others = [c[0][c[4]] for c in cursors[pivot + 1 :]]
                target = min([e + 1 for e in ends] + others, default=item + 1)
                for c in ahead:
                    self._seek(c, max(target, item + 1))
            cursors = [c for c in cursors if c[4] < len(c[0])]
        return found

    @staticmethod
    def _seek(c: list, item: int) -> None:
        ks, at, n = c[0], c[4], len(c[0])
        while at < n and ks[at] < item:
            stop = min(n, (at // BLOCK + 1) * BLOCK)
            if ks[stop - 1] < item:
                at = stop
            else:
                at += 1
        c[4] = at
