"""Rolling hashes and sliding minima over many texts at once, in numpy."""

from __future__ import annotations

import numpy as np

_ODD = 0x9E3779B97F4A7C15


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit values."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(30))
        h = h * np.uint64(0xBF58476D1CE4E5B9)
        h = h ^ (h >> np.uint64(27))
        h = h * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def grams(items: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of every run of k items; entry i is the run that starts at i.

    The run's hash is a polynomial in an odd base, built by doubling, so it costs a
    few passes whatever k is.
    """
    n = len(items)
    if n < k:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        span, part = 1, mix(items.astype(np.uint64, copy=False))
        out, have = None, 0
        left = k
        while True:
            if left & 1:
                if out is None:
                    out, have = part, span
                else:
                    m = min(len(out) - span, len(part)) if len(out) > span else 0
                    out = part[: len(out) - span] * np.uint64(pow(_ODD, have, 1 << 64)) + out[span : span + len(part)] if m else out[:0]
                    have += span
            left >>= 1
            if not left:
                break
            part = part[: len(part) - span] * np.uint64(pow(_ODD, span, 1 << 64)) + part[span:]
            span *= 2
        return mix(out[: n - k + 1])


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values; entry i is the window that starts at i."""
    if len(h) < w:
        return h[:0]
    span, m = 1, h
    while span * 2 <= w:
        m = np.minimum(m[: len(m) - span], m[span:])
        span *= 2
    rest = w - span
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in one array, and the offsets at which each text starts and ends."""
    parts = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in texts]
    ends = np.cumsum([0, *[len(p) for p in parts]])
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint32)), ends


def winnowed(texts: list[str], k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of text, fingerprint): minima of all windows of w k-grams of characters, once for each text.

    Two texts that share a stretch of k + w - 1 characters share every fingerprint of
    that stretch.
    """
    points, ends = code_points(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(ends))
    m = sliding_min(grams(points, k), w)
    if not len(m):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    whole = owner[: len(m)] == owner[k + w - 2 : k + w - 2 + len(m)]
    new = np.r_[True, (m[1:] != m[:-1]) | (owner[1 : len(m)] != owner[: len(m) - 1]) | ~whole[:-1]]
    at = np.flatnonzero(whole & new)
    both = np.unique(np.stack([owner[at].astype(np.uint64), m[at]], axis=1), axis=0) if len(at) else np.zeros((0, 2), np.uint64)
    return both[:, 0].astype(np.int64), both[:, 1]
