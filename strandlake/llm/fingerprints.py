"""Shingle fingerprints: lower-cased words, three-word shingles, XXH64 majority bits."""

from __future__ import annotations

import numpy as np
import xxhash

SHINGLE_WORDS = 3
HASH_SEED = 42


def shingle_hashes(data: bytes, size: int = SHINGLE_WORDS, seed: int = HASH_SEED) -> np.ndarray:
    """XXH64 of every shingle of UTF-8 ``data``, repeats included.

    Words are runs of bytes other than space and U+0009..U+000D; only A-Z are
    lower-cased. Fewer words than ``size`` make one shingle of the whole
    sequence; no words make an empty array.
    """
    words = data.lower().split()
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(b" ".join(words), seed)] if words else [], dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[: -size])).tolist()
    stops = (ends[size - 1 :] - 1).tolist()
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts, stops)], dtype=np.uint64)


def majority_bits(hashes: np.ndarray) -> int:
    """64-bit fingerprint: a bit is one when set in more than half of ``hashes``; none give zero."""
    if not len(hashes):
        return 0
    set_in = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        block = hashes[k : k + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        set_in += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(set_in * 2 > len(hashes)).tobytes(), "big")


def simhash(data: bytes | None) -> int:
    """Fingerprint of one UTF-8 text; null counts as empty."""
    return majority_bits(shingle_hashes(data or b""))
