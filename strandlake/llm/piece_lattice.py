"""Segmentation of text over a piece lattice: forward Viterbi and backward A-star for the N best.

A SentencePiece file gives the pieces. Its byte-pair scores are merge orders,
so a piece's log-probability is taken from its order by a Zipf-Mandelbrot law,
in whole thousandths, which makes sums exact. A character that no piece covers
is spelled in byte pieces at the lowest probability.

Text is led by one space, and spaces stand for themselves: a literal U+2581 in
the text is spelled in bytes, so decoding gives back every text exactly. No
piece holds a space after another character, and none a line feed, so the
lattice falls apart into units (a word with the spaces before it, or a line
feed) whose segmentations are independent; units are solved once and kept.
The forward pass runs over many new units at once, one array step a lattice edge.
"""

from __future__ import annotations

import math
import re
import struct
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache, partial
from itertools import compress, islice
from operator import not_

import numpy as np

UNIT = re.compile(r"\n| *[^ \n]+| +")
SHIFT = 2.7
SCALE = 1000
#: Units kept in each of two generations, and the longest units (in characters) that are solved many at once.
UNIT_STORE = 200_000
TOGETHER = 32
#: Units of one forward pass, and edges of all of them at most.
UNITS_AT_ONCE = 4096
EDGES_AT_ONCE = 1 << 19
#: A key is a score times TOGETHER plus a piece's length less one, within 32 bits; keys this low are of no edge.
NO_EDGE = -(1 << 29)
NEVER = 1 << 60
#: Stands for the id where a character is spelled in bytes.
SPELLED = 0xFFFF
#: N of the N best.
N_BEST = 4
#: Longer units are solved whole like any other, but not kept in the stores, whose bytes stay bounded.
LONGEST_KEPT = 2000
#: A solved unit is one string of bytes: ids as little-endian unsigned 16-bit integers, then score and margin.
TAIL = struct.Struct("<qq")


class Pieces:
    """The pieces of a model file with log-probabilities, their prefixes, and bytes for decoding."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        if n > SPELLED:
            raise ValueError("ids don't fit 16 bits")
        self.floor = -round(SCALE * math.log(n + SHIFT))
        self.byte_ids = [0] * 256
        self.data: list[bytes] = [b""] * n
        #: Tree of the pieces by character; a node is [children, log-probability or None, id].
        self.tree: dict[str, list] = {}
        for i in range(n):
            text = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(text[3:5], 16)
                self.byte_ids[value], self.data[i] = i, bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                text, order = text.replace("▁", " "), -model.get_score(i)
                if " " in text.lstrip(" ") or "\n" in text or not text.strip(" ") == text.lstrip(" "):
                    raise ValueError("a piece spans units")
                self.data[i] = text.encode()
                below, node = self.tree, None
                for c in text:
                    node = below.setdefault(c, [{}, None, 0])
                    below = node[0]
                node[1:] = -round(SCALE * math.log(min(max(order, 0.0), n) + SHIFT)), i

        self.steps = Steps(self.tree)

    def spelled(self, c: str) -> tuple[int, tuple[int, ...]]:
        """Log-probability and ids of a character in byte pieces."""
        data = c.encode("utf-8", "surrogatepass")
        return self.floor * len(data), tuple(self.byte_ids[x] for x in data)

    def edges_from(self, unit: str, i: int) -> list[tuple[int, int, tuple[int, ...]]]:
        """Edges (end, log-probability, ids) that start at ``i``, shortest first."""
        own, below, j, size = [], self.tree, i, len(unit)
        while j < size and (node := below.get(unit[j])) is not None:
            below, j = node[0], j + 1
            if node[1] is not None:
                own.append((j, node[1], (node[2],)))
        if not own or own[0][0] != i + 1:
            own.insert(0, (i + 1, *self.spelled(unit[i])))
        return own

    def edges(self, unit: str) -> list[list[tuple[int, int, tuple[int, ...]]]]:
        """Per start the edges (end, log-probability, ids), shortest first."""
        return [self.edges_from(unit, i) for i in range(len(unit))]

    def best(self, unit: str) -> bytes:
        """Best path of a unit: its ids, then score and margin to the second best as a TAIL.

        The same forward pass as ``viterbi``, without the lists of edges.
        """
        size, tree = len(unit), self.tree
        low = -NEVER
        row = list if size <= LONGEST_KEPT else partial(array, "q")
        best, second, back = (row([low]) * (size + 1) for _ in range(3))
        best[0] = 0
        # ``back`` holds start * 2^16 + id.
        for i in range(size):
            at, below, j, start = best[i], tree, i, i << 16
            node = below.get(unit[i])
            if node is None or node[1] is None:
                v = at + self.spelled(unit[i])[0]
                if v > best[i + 1]:
                    second[i + 1], best[i + 1], back[i + 1] = best[i + 1], v, start | SPELLED
                elif v > second[i + 1]:
                    second[i + 1] = v
            while node is not None:
                j += 1
                s = node[1]
                if s is not None:
                    v = at + s
                    if v > best[j]:
                        second[j], best[j], back[j] = best[j], v, start | node[2]
                    elif v > second[j]:
                        second[j] = v
                if j == size:
                    break
                node = node[0].get(unit[j])
        margin, ids, j = NEVER, array("H"), size
        while j:
            margin = min(margin, best[j] - second[j])
            j, own = back[j] >> 16, back[j] & 0xFFFF
            if own == SPELLED:
                ids.extend(reversed(self.spelled(unit[j])[1]))
            else:
                ids.append(own)
        ids.reverse()
        return struct.pack(f"<{len(ids)}H", *ids) + TAIL.pack(best[size], margin if margin < NEVER // 2 else NEVER)


class Steps:
    """The tree of pieces as arrays: from a node (0 the root) and a character to the next node, its score and its id."""

    def __init__(self, tree: dict[str, list]):
        letters: dict[str, int] = {}
        keys, score, ids, work, self.deepest = [], [-NEVER], [0], [(0, 1, tree)], 0
        while work:
            node, depth, below = work.pop()
            for c, (children, own, own_id) in below.items():
                keys.append((node, letters.setdefault(c, len(letters) + 1), len(score)))
                work.append((len(score), depth + 1, children))
                score.append(-NEVER if own is None else own)
                ids.append(own_id)
                self.deepest = max(self.deepest, depth)
        self.edge = np.array([NO_EDGE if x == -NEVER else x * TOGETHER for x in score], np.int32)
        self.ids = np.array(ids, np.int64)
        #: Number of each character that pieces hold, by code point; 0 for all others.
        self.letter = np.zeros(max(map(ord, letters), default=0) + 2, np.int64)
        for c, k in letters.items():
            self.letter[ord(c)] = k
        self.width = len(letters) + 1
        at = np.array([n * self.width + c for n, c, _ in keys], np.int64)
        # Open addressing at a load of a quarter at most; ``probes`` steps find any key that is there.
        self.bits = max(4, (4 * len(at) - 1).bit_length())
        self.key, self.to = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        slot, left, self.probes = self._slots(at), np.arange(len(at)), 0
        while len(left):
            own = (slot[left] + self.probes) & (len(self.key) - 1)
            free = self.key[own] < 0
            _, first = np.unique(own[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.key[own[won]], self.to[own[won]] = at[left[won]], [keys[i][2] for i in left[won]]
            left = np.delete(left, won)
            self.probes += 1

    def _slots(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def next(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The node after ``node`` by ``letter``, 0 where no piece goes on."""
        key = node * self.width + letter
        slot, found, left = self._slots(key), np.zeros(len(key), np.int64), np.arange(len(key))
        for k in range(self.probes):
            at = (slot[left] + k) & (len(self.key) - 1)
            own = self.key[at]
            hit = own == key[left]
            found[left[hit]] = self.to[at[hit]]
            left = left[~hit & (own >= 0)]
            if not len(left):
                break
        return found


def best_of_many(pieces: Pieces, units: list[str]) -> list[bytes]:
    """What ``Pieces.best`` gives for each of ``units`` (no longer than TOGETHER), by one forward pass over all."""
    steps, n = pieces.steps, len(units)
    sizes = np.fromiter(map(len, units), np.int64, n)
    longest = int(sizes.max())
    points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = np.arange(longest)[None, :] < sizes[:, None]
    text = np.zeros((n, longest), np.int64)
    text[inside] = points
    letter = np.where(text < len(steps.letter), steps.letter[np.minimum(text, len(steps.letter) - 1)], 0)
    # Keys and ids of edges by length, start and unit. A character without a piece of its own is spelled.
    deepest = max(1, min(steps.deepest, longest))
    edge, ids = np.full((deepest, longest, n), NO_EDGE, np.int32), np.zeros((deepest, longest, n), np.uint16)
    unit, start = np.nonzero(inside)
    node = np.zeros(len(unit), np.int64)
    for k in range(deepest):
        alive = start + k < sizes[unit]
        unit, start, node = unit[alive], start[alive], node[alive]
        node = steps.next(node, letter[unit, start + k])
        on = node > 0
        unit, start, node = unit[on], start[on], node[on]
        edge[k, start, unit], ids[k, start, unit] = steps.edge[node] + np.int32(k), steps.ids[node]
    lone = inside.T & (edge[0] == NO_EDGE)
    cost = (pieces.floor * TOGETHER) * (1 + (text > 0x7F).astype(np.int32) + (text > 0x7FF) + (text > 0xFFFF)).T
    edge[0][lone], ids[0][lone] = cost[lone], SPELLED
    # The best and the second best key up to every node; of equal scores the key of the longest piece is the best.
    best, second = np.full((longest + 1, n), NO_EDGE, np.int32), np.full((longest + 1, n), 2 * NO_EDGE, np.int32)
    at = np.zeros((longest + 1, n), np.int32)
    key, less = np.empty(n, np.int32), np.empty(n, np.int32)
    for j in range(1, longest + 1):
        for k in range(min(j, deepest)):
            np.add(at[j - 1 - k], edge[k, j - 1 - k], out=key)
            np.minimum(best[j], key, out=less)
            np.maximum(second[j], less, out=second[j])
            np.maximum(best[j], key, out=best[j])
        np.bitwise_and(best[j], -TOGETHER, out=at[j])
    reached = at // TOGETHER
    # Back along the best paths of all units at once; ids fill their rows from the right.
    every = np.arange(n)
    row, at_end, margin, used = np.zeros((n, longest), np.uint16), sizes.copy(), np.full(n, NEVER, np.int64), np.zeros(n, np.int64)
    while True:
        on = np.flatnonzero(at_end > 0)
        if not len(on):
            break
        j = at_end[on]
        other = second[j, on]
        margin[on] = np.minimum(margin[on], np.where(other > NO_EDGE // 2, reached[j, on] - other // TOGETHER, np.int64(NEVER)))
        used[on] += 1
        k = best[j, on] % TOGETHER
        row[on, longest - used[on]] = ids[k, j - 1 - k, on]
        at_end[on] -= k + 1
    tail = np.stack([reached[sizes, every], margin], axis=1).astype("<i8").tobytes()
    flat, width = row.astype("<u2").tobytes(), 2 * longest
    spelled = ((row == SPELLED) & (np.arange(longest) >= longest - used[:, None])).any(axis=1)
    out = [flat[(i + 1) * width - 2 * u : (i + 1) * width] + tail[16 * i : 16 * i + 16] for i, u in enumerate(used.tolist())]
    for i in np.flatnonzero(spelled).tolist():
        out[i] = pieces.best(units[i])
    return out


def viterbi(edges) -> tuple[list[int], list[int], tuple[int, ...]]:
    """Best score up to every node, the margin to the second best whole path, and the best path's ids."""
    size = len(edges)
    low = -(1 << 60)
    best, second, back = [low] * (size + 1), [low] * (size + 1), [None] * (size + 1)
    best[0] = 0
    for i, own in enumerate(edges):
        at = best[i]
        for e in own:
            j, v = e[0], at + e[1]
            if v > best[j]:
                second[j], best[j], back[j] = best[j], v, (i, e[2])
            elif v > second[j]:
                second[j] = v
    margin, ids, j = 1 << 60, [], size
    while j:
        margin = min(margin, best[j] - second[j])
        i, own = back[j]
        ids.append(own)
        j = i
    return best, [margin], tuple(x for own in reversed(ids) for x in own)


def n_best(edges, n: int) -> list[tuple[int, tuple[int, ...]]]:
    """The ``n`` best (score, ids) of a unit by backward A-star; forward Viterbi scores are the exact heuristic.

    Ties are ordered by the lengths of the pieces from the end, longest first.
    The open ends of paths are kept in that order and carry links to what follows
    them. Each has a completion of just its score and no two share one, so no more
    than the paths still sought need stay open.
    """
    size, reach = len(edges), 0
    best = array("q", [-NEVER]) * (size + 1)
    best[0] = 0
    for i, own in enumerate(edges):
        at = best[i]
        for j, s, _ in own:
            if at + s > best[j]:
                best[j] = at + s
        reach = max(reach, own[-1][0] - i)
    front = [(best[size], size, 0, None)]
    found = []
    while front and len(found) < n:
        k = max(range(len(front)), key=lambda x: front[x][0])
        f, j, tail, after = front.pop(k)
        if j == 0:
            ids = []
            while after is not None:
                own, after = after
                ids.extend(own)
            found.append((f, tuple(ids)))
            continue
        front[k:k] = [(best[i] + s + tail, i, tail + s, (ids, after)) for i in range(max(0, j - reach), j) for end, s, ids in edges[i] if end == j]
        if len(front) > n - len(found):
            kept = sorted(range(len(front)), key=lambda x: -front[x][0])[: n - len(found)]
            front = [front[x] for x in sorted(kept)]
    return found


def spliced(best: bytes, ends: np.ndarray, change: dict[int, bytes]) -> bytes:
    """The ids of a path that leaves the best one in the units of ``change``."""
    parts, at = [], 0
    for k in sorted(change):
        parts += [best[at : int(ends[k - 1]) if k else 0], change[k]]
        at = int(ends[k])
    return b"".join([*parts, best[at:]])


class Lattice:
    """Edges of a long unit, found when they are asked for."""

    def __init__(self, pieces: Pieces, unit: str):
        self.pieces, self.unit = pieces, unit

    def __len__(self) -> int:
        return len(self.unit)

    def __getitem__(self, i: int) -> list[tuple[int, int, tuple[int, ...]]]:
        if i >= len(self.unit):
            raise IndexError(i)
        return self.pieces.edges_from(self.unit, i)


class Segmenter:
    """N best segmentations of whole texts; solved units are kept in two bounded generations."""

    def __init__(self, path: str, n: int = N_BEST, store: int = UNIT_STORE):
        self.pieces, self.n, self.store = Pieces(path), n, store
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.lists: dict[str, list] = {}

    def units(self, text: str) -> list[str]:
        return UNIT.findall(" " + text)

    def solve(self, units: Iterable[str]) -> dict[str, bytes]:
        """Ids, score and margin of distinct units, as ``Pieces.best`` gives them; new ones are kept if not long."""
        found, short = {}, []
        for u in units:
            got = self.new.get(u) or self.old.get(u)
            if got is not None:
                found[u] = got
            elif len(u) > TOGETHER:
                found[u] = self.pieces.best(u)
            else:
                short.append(u)
        short.sort(key=len)
        while short:
            n = max(1, min(UNITS_AT_ONCE, EDGES_AT_ONCE // max(1, len(short[-1])) ** 2))
            part = short[-n:]
            del short[-n:]
            found.update(zip(part, best_of_many(self.pieces, part)))
        if len(self.new) + len(found) > self.store:
            self.old, self.new = self.new, {}
        if len(found) <= self.store and not any(len(u) > LONGEST_KEPT for u in found):
            self.new.update(found)
        else:
            room = self.store - len(self.new)
            self.new.update((u, x) for u, x in islice(found.items(), room) if len(u) <= LONGEST_KEPT)
        return found

    def alternatives(self, unit: str) -> list[tuple[int, bytes]]:
        if len(unit) > LONGEST_KEPT:
            return self._packed(n_best(Lattice(self.pieces, unit), self.n))
        got = self.lists.get(unit)
        if got is None:
            if len(self.lists) >= self.store // 10:
                self.lists.clear()
            got = self.lists[unit] = self._packed(n_best(self.pieces.edges(unit), self.n))
        return got

    @staticmethod
    def _packed(found: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, bytes]]:
        return [(s, struct.pack(f"<{len(ids)}H", *ids)) for s, ids in found]

    def segment(self, text: str) -> tuple[list[bytes], list[int], list[dict[int, bytes]]]:
        """What ``segment_all`` gives for one text, with the ids unit by unit."""
        best, ends, scores, changes = next(self.segment_all([text]))
        starts = [0, *ends[:-1].tolist()]
        return [best[a:b] for a, b in zip(starts, ends.tolist())], scores, changes

    def segment_all(self, texts: list[str]) -> Iterator[tuple[bytes, np.ndarray, list[int], list[dict[int, bytes]]]]:
        """Per text the ids of the best path, where each unit's ids end in it, the N best scores, and for each of these the units that differ from the best."""
        known = self.new
        of_text = [self.units(t) for t in texts]
        of_known = [list(map(known.get, units)) for units in of_text]
        fresh = set()
        for units, got in zip(of_text, of_known):
            fresh.update(compress(units, map(not_, got)))
        solved = self.solve(fresh) if fresh else {}
        for units, got in zip(of_text, of_known):
            # A unit that was known stands for itself where nothing new was solved for it.
            yield self._n_best(units, list(map(solved.get, units, got)) if fresh else got)

    def _n_best(self, units: list[str], got: list[bytes]) -> tuple[bytes, np.ndarray, list[int], list[dict[int, bytes]]]:
        """The N best of a text from its units and what solves them.

        A path among the N best leaves the best only in units of the N - 1 least
        margins, for each of those alone gives as many paths that are no worse.
        """
        whole = np.frombuffer(b"".join(got), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, got), np.int64, len(got)))
        at_tail = (ends - TAIL.size)[:, None] + np.arange(TAIL.size)
        tails = whole[at_tail].view("<i8")
        inside = np.ones(len(whole), bool)
        inside[at_tail] = False
        best, ends = whole[inside].tobytes(), ends - TAIL.size * np.arange(1, len(got) + 1)
        score, margins = int(tails[:, 0].sum()), tails[:, 1].copy()
        few = []
        for _ in range(min(self.n - 1, len(margins))):
            k = int(margins.argmin())
            if margins[k] < NEVER:
                few.append(k)
            margins[k] = NEVER
        lists = [[(s - int(tails[k, 0]), k, own) for s, own in self.alternatives(units[k])] for k in few]
        ways = [((), 0)]
        for own in lists:
            # Taken one list after the other, only the n best of what came before can be among the n best.
            ways = sorted((((*c, i), v + x[0]) for c, v in ways for i, x in enumerate(own)), key=lambda w: (-w[1], w[0]))[: self.n]
        scores = [score + v for _, v in ways]
        changes = [{x[i][1]: x[i][2] for x, i in zip(lists, c) if i} for c, _ in ways]
        return best, ends, scores, changes

    def decode(self, data: bytes) -> str:
        """The text of ids given as little-endian unsigned 16-bit integers."""
        table = self.pieces.data
        raw = b"".join([table[i] for i in memoryview(data).cast("H")]) if data else b" "
        return raw.decode("utf-8", "surrogatepass")[1:]


@lru_cache(maxsize=2)
def segmenter(path: str, n: int = N_BEST) -> Segmenter:
    """One segmenter a Python worker, kept from task to task."""
    return Segmenter(path, n)
