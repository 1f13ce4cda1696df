"""Statistics of one whole text that tell prose from noise, as a fixed-length vector."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np

NAMES = (
    "log_words", "log_chars", "word_len", "word_len_sd", "unique_words", "top_word", "repeat_next", "lines_per_word", "dup_lines",
    "upper", "digits", "symbols", "bangs", "bars", "stops", "commas", "other_ascii", "wide", "symbol_words", "caps_words",
    "sentence_len", "unique_pairs", "half_unique", "bracket",
)

_SETS = {
    "upper": range(65, 91), "digits": range(48, 58), "symbols": b"#$%&*+=@\\^_~`", "bangs": b"!?", "bars": b"|/", "stops": b".", "commas": b",;:",
    "other_ascii": [*range(0, 9), *range(14, 32), 127], "wide": range(128, 256), "bracket": b"<>{}[]()",
}
_TABLE = np.zeros((len(_SETS), 256), np.float64)
for _k, _v in enumerate(_SETS.values()):
    _TABLE[_k, list(_v)] = 1
_AT = {k: i for i, k in enumerate(_SETS)}


def stats(text: str | None) -> list[float]:
    """The statistics of ``text``, all finite; null and empty texts give zeros."""
    if not text:
        return [0.0] * len(NAMES)
    data = text.encode("utf-8", "replace")
    share = _TABLE @ np.bincount(np.frombuffer(data, np.uint8), minlength=256) / len(data)
    words = text.split()
    n = len(words)
    if not n:
        return [0.0, math.log1p(len(text)), *[0.0] * (len(NAMES) - 2)]
    lens = np.fromiter(map(len, words), np.float64, n)
    counts = Counter(words)
    pairs = len(set(zip(words, words[1:])))
    lines = [x for x in text.split("\n") if x.strip()]
    half = words[: (n + 1) // 2]
    ends = max(1, data.count(b". ") + data.count(b".\n") + data.endswith(b"."))
    tails = [w[-1] for w in words]
    return [
        math.log1p(n), math.log1p(len(text)), min(lens.mean(), 50.0), min(lens.std(), 50.0), len(counts) / n, max(counts.values()) / n,
        sum(map(str.__eq__, words, words[1:])) / n, len(lines) / n, 1 - len(set(lines)) / max(1, len(lines)),
        *(share[_AT[k]] for k in ("upper", "digits", "symbols", "bangs", "bars", "stops", "commas", "other_ascii", "wide")),
        sum(map("#$%&*+=@^~|!".__contains__, tails)) / n, sum(map(str.isupper, words)) / n,
        math.log1p(n / ends), pairs / max(1, n - 1), len(set(half)) / len(half), share[_AT["bracket"]],
    ]
