"""Hashed word n-gram sets and MinHash bands of texts, in numpy."""

from __future__ import annotations

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}
#: Shingles hashed at a time, so that very long texts need no more memory.
STEP = 8192


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        with np.errstate(over="ignore"):
            have = np.cumprod(np.concatenate([[U(1)], np.full(max(n, 1 << 14), U(base))]), dtype=U)
        _POWERS[base] = have
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the output."""
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-grams of words; a text of fewer
    words has one n-gram of all it has, one without words none."""
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), dtype=np.uint8)
    word = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edge = np.diff(np.concatenate([[0], word.view(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.empty(0, dtype=U)
    with np.errstate(over="ignore"):
        sums = np.concatenate([[U(0)], np.cumsum((raw.astype(U) + U(1)) * _powers(_BASE, len(raw)), dtype=U)])
        words = mixed((sums[end] - sums[start]) * _powers(_INVERSE, len(raw) + 1)[start] + (end - start).astype(U))
        k = min(n, len(words))
        grams = words[: len(words) - k + 1]
        for j in range(1, k):
            grams = mixed(grams * U(3) + words[j : len(words) - k + 1 + j])
    return np.unique(grams)


def band_hashes(grams: np.ndarray, bands: int, rows: int) -> np.ndarray | None:
    """One 64-bit hash per band of ``rows`` MinHash values."""
    if not len(grams):
        return None
    rng = np.random.default_rng(20240613)
    a, b = rng.integers(0, 1 << 63, (2, bands * rows, 1), dtype=U)
    least = np.full(bands * rows, U(0xFFFFFFFFFFFFFFFF))
    with np.errstate(over="ignore"):
        for i in range(0, len(grams), STEP):
            least = np.minimum(least, (grams[None, i : i + STEP] * (a | U(1)) + b).min(axis=1))
        out = np.arange(bands, dtype=U) + U(1)
        for column in mixed(least).reshape(bands, rows).T:
            out = mixed(out * U(5) + column)
    return out.view(np.int64)


def choose_bands(similarity: float, recall: float, most_hashes: int) -> tuple[int, int]:
    """(bands, rows): as many rows a band as the target recall at ``similarity``
    allows within ``most_hashes`` values, so that few other pairs meet."""
    best = (most_hashes, 1)
    for rows in range(1, most_hashes + 1):
        bands = most_hashes // rows
        if 1 - (1 - similarity**rows) ** bands >= recall:
            best = (bands, rows)
    return best
