"""Winnowed anchors: every 100-byte window of a text is given to one of its 24-byte strings, by content alone."""

from __future__ import annotations

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20240917))
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        inverse = pow(_BASE, -1, 1 << 64)
        out = []
        for base in (_BASE, inverse):
            p = np.ones(size, np.uint64)
            have, step = 1, base
            while have < size:
                p[have : 2 * have] = p[:have] * np.uint64(step)
                step = step * step % (1 << 64)
                have *= 2
            out.append(p)
        _POWERS[size] = tuple(out)
    return _POWERS[size]


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k consecutive bytes of data (uint8)."""
    n = len(data)
    if n < k:
        return np.empty(0, np.uint64)
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:n], out=sums[1:])
    h = (sums[k:] - sums[:-k]) * down[: n - k + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    m, width = h, 1
    while width * 2 <= w:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    return np.minimum(m[: len(h) - w + 1], m[w - width : len(h) - w + 1 + w - width]) if width < w else m


def anchors(data: np.ndarray, starts: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, anchor hash): runs of windows with the same anchor.

    data: texts one after another, starts: where each begins, with the end of data last. No window crosses texts. The
    anchor of a window is the leftmost of its k-byte strings with the least hash, so equal windows have equal ones.
    """
    w = window - k + 1
    n = len(data) - window + 1
    none = np.empty(0, np.int64)
    if n <= 0:
        return none, none, np.empty(0, np.uint64)
    h = gram_hashes(data, k)
    m = sliding_min(h, w)
    valid = np.ones(n, bool)
    fresh = np.ones(n, bool)
    np.not_equal(m[1:], m[:-1], out=fresh[1:])
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        valid[max(a, b - window + 1) : b] = False
        if a < n:
            fresh[a] = True
    begin = np.flatnonzero(fresh & valid)
    if not len(begin):
        return none, none, np.empty(0, np.uint64)
    # a run ends where the next begins, or where windows stop being valid
    stops = np.flatnonzero(np.concatenate((valid[:-1] & ~valid[1:], [valid[-1]]))) + 1
    ends = np.minimum(np.concatenate((begin[1:], [n])), stops[np.searchsorted(stops, begin, "right")])
    ramp = np.arange(w)

    def place(at: np.ndarray) -> np.ndarray:
        out = np.empty(len(at), np.int64)
        for lo in range(0, len(at), 1 << 14):
            part = at[lo : lo + (1 << 14)]
            out[lo : lo + (1 << 14)] = part + h[part[:, None] + ramp].argmin(1)
        return out

    pos = place(begin)
    tied = ends - 1 > pos  # windows past the anchor have the same least value elsewhere
    if tied.any():
        more = np.concatenate([np.arange(p + 1, e) for p, e in zip(pos[tied].tolist(), ends[tied].tolist())])
        at = place(more)
        new = np.concatenate(([True], (at[1:] != at[:-1]) | (more[1:] != more[:-1] + 1)))
        edge = np.flatnonzero(np.concatenate((new, [True])))
        ends[tied] = pos[tied] + 1
        begin = np.concatenate((begin, more[edge[:-1]]))
        ends = np.concatenate((ends, more[edge[1:] - 1] + 1))
        pos = np.concatenate((pos, at[edge[:-1]]))
    return begin, ends - begin, h[pos]
