"""Score-aware product quantisation: codebooks of 16 entries, fitted to keep inner products.

The loss of a vector x quantised to y is |e|^2 + (eta - 1) (u . e)^2 with
e = x - y and u = x / |x|: error along x, which moves the largest inner
products, costs eta times as much as error across it.
"""

from __future__ import annotations

import numpy as np

ENTRIES = 16
WIDTH = 2
#: Inner products above this share of the norm matter; it sets eta.
THRESHOLD = 0.2
SWEEPS = 3
SEED = 9


def eta_of(dim: int, threshold: float = THRESHOLD) -> float:
    return max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2))


def pad(x: np.ndarray) -> np.ndarray:
    """Zero columns up to a multiple of two subspaces, so that codes pack into bytes."""
    short = -x.shape[1] % (2 * WIDTH)
    return np.pad(x, ((0, 0), (0, short))) if short else x


def _units(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def assign(x: np.ndarray, books: np.ndarray, eta: float) -> np.ndarray:
    """Codes (rows x subspaces) by coordinate descent on the anisotropic loss; ``x`` is padded."""
    n, parts = len(x), len(books)
    u = _units(x)
    codes = np.zeros((n, parts), np.uint8)
    along = np.zeros((n, parts))
    for sweep in range(SWEEPS + 1):
        total = along.sum(axis=1)
        for m in range(parts):
            cols = slice(m * WIDTH, (m + 1) * WIDTH)
            e = x[:, None, cols] - books[m][None]
            loss = (e * e).sum(axis=2)
            par = np.einsum("nkd,nd->nk", e, u[:, cols])
            if sweep:
                rest = total - along[:, m]
                loss = loss + (eta - 1) * (rest[:, None] + par) ** 2
            best = loss.argmin(axis=1)
            now = par[np.arange(n), best]
            total = total - along[:, m] + now
            codes[:, m], along[:, m] = best, now
    return codes


def _update(x: np.ndarray, codes: np.ndarray, eta: float, parts: int, old: np.ndarray) -> np.ndarray:
    """Codebooks of least anisotropic loss for fixed codes, by the normal equations."""
    u, size = _units(x), parts * ENTRIES * WIDTH
    at = (np.arange(parts) * ENTRIES + codes)[:, :, None] * WIDTH + np.arange(WIDTH)
    at = at.reshape(len(x), -1)
    a, b = np.zeros((size, size)), np.zeros(size)
    flat = a.reshape(-1)
    for i in range(0, len(x), 256):
        k, v = at[i : i + 256], u[i : i + 256]
        outer = (eta - 1) * v[:, :, None] * v[:, None, :] + np.eye(v.shape[1])
        flat += np.bincount((k[:, :, None] * size + k[:, None, :]).ravel(), outer.ravel(), size * size)
        target = x[i : i + 256] + (eta - 1) * v * (v * x[i : i + 256]).sum(axis=1, keepdims=True)
        b += np.bincount(k.ravel(), target.ravel(), size)
    ridge = 1e-3
    flat[:: size + 1] += ridge
    return np.linalg.solve(a, b + ridge * old.ravel()).reshape(parts, ENTRIES, WIDTH)


def fit(sample: np.ndarray, rounds: int = 3) -> np.ndarray:
    """Codebooks (subspaces x 16 x WIDTH) from sample rows: k-means by subspace, then anisotropic rounds."""
    x = pad(np.asarray(sample, np.float64))
    parts, rng = x.shape[1] // WIDTH, np.random.default_rng(SEED)
    books = np.zeros((parts, ENTRIES, WIDTH))
    if not len(x):
        return books
    for m in range(parts):
        own = x[:, m * WIDTH : (m + 1) * WIDTH]
        c = own[rng.choice(len(own), ENTRIES, replace=len(own) < ENTRIES)]
        for _ in range(8):
            near = ((own[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
            n = np.bincount(near, minlength=ENTRIES)
            for d in range(WIDTH):
                c[:, d] = np.where(n > 0, np.bincount(near, own[:, d], ENTRIES) / np.maximum(n, 1), c[:, d])
        books[m] = c
    eta = eta_of(x.shape[1])
    for _ in range(rounds):
        books = _update(x, assign(x, books, eta), eta, parts, books)
    return books


def pack(codes: np.ndarray) -> np.ndarray:
    """Two four-bit codes a byte."""
    return codes[:, 0::2] | codes[:, 1::2] << 4


def tables(queries: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Per query and byte, the inner product of each pair of codes (queries x bytes x 256)."""
    q = pad(queries).reshape(len(queries), len(books), WIDTH)
    one = np.einsum("qmd,mkd->qmk", q, books).astype(np.float32)
    low, high = one[:, 0::2], one[:, 1::2]
    return (high[:, :, :, None] + low[:, :, None, :]).reshape(len(queries), -1, 256)


def scan(packed: np.ndarray, lut: np.ndarray) -> np.ndarray:
    """Approximate inner products (queries x rows) by table lookups over the packed codes."""
    out = np.zeros((len(lut), len(packed)), np.float32)
    for j in range(packed.shape[1]):
        out += lut[:, j].take(packed[:, j], axis=1)
    return out


def error(x: np.ndarray, packed: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Per row the most by which a unit query's ``scan`` can miss its inner product: quantisation and rounding."""
    codes = np.stack([packed & 15, packed >> 4], axis=2).reshape(len(packed), -1)
    y = books[np.arange(len(books)), codes].reshape(len(x), -1)
    rounding = (packed.shape[1] + 4) * 1.2e-7
    return np.linalg.norm(pad(x) - y, axis=1) + rounding * np.linalg.norm(y, axis=1)
