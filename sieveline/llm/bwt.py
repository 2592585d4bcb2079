"""Common prefixes up to a bound by breadth-first backward extension on a Burrows-Wheeler transform."""

from __future__ import annotations

import numpy as np


def rotations(sym: np.ndarray, depth: int) -> np.ndarray:
    """Positions of sym's rotations in the order of their first `depth` symbols, at least; prefix doubling on what is still tied."""
    n = len(sym)
    bits = max(1, int(sym.max()).bit_length())
    have = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for j in range(have):
        key = (key << bits) | np.roll(sym, -j)
    order = np.argsort(key)
    head = np.concatenate(([True], np.diff(key[order]) != 0))
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(head)[np.cumsum(head) - 1]
    while have < min(depth, n):
        last = np.concatenate((head[1:], [True]))
        slots = np.flatnonzero(~(head & last))  # places of groups of two or more
        if not len(slots):
            break
        own = order[slots]
        nxt = own + have
        nxt[nxt >= n] %= n
        key = rank[own] * n + rank[nxt]
        by = np.argsort(key)
        key, own = key[by], own[by]
        order[slots] = own
        fresh = np.concatenate(([True], np.diff(key) != 0))
        head[slots] = fresh
        rank[own] = slots[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
        have *= 2
    return order


def bounded_prefix_classes(sym: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, boundary): rotations sorted by their first symbols, and where a rotation shares fewer than `depth` with the one before.

    The common prefix of neighbours is derived by increasing value: the empty string's interval is extended to the
    left by each symbol, level by level; when an interval of length l + 1 first reaches a right end, the two rotations
    there have l symbols in common. Levels stop at depth - 1, so what is still open has at least `depth` in common.
    """
    n = len(sym)
    order = rotations(sym, depth)
    last = sym[order - 1]  # the transform: the symbol before each rotation, round the end
    by_last = np.argsort(last, kind="stable")
    back = np.empty(n, np.int64)  # where each rotation's left extension stands
    back[by_last] = np.arange(n)
    first = sym[order]
    change = np.concatenate(([True], first[1:] != first[:-1]))
    closed = np.zeros(n + 1, bool)
    closed[0] = closed[n] = True
    owner = np.full(n, -1, np.int64)
    lo, hi, base = np.array([0]), np.array([n]), 0
    for _ in range(depth):
        size = hi - lo
        total = int(size.sum())
        if not total:
            break
        ids = np.repeat(np.arange(base, base + len(lo)), size)
        at = np.arange(total) + np.repeat(lo - np.concatenate(([0], np.cumsum(size)[:-1])), size)
        to = back[at]
        owner[to] = ids
        if 6 * total >= n:
            mine = owner >= base
            new = np.flatnonzero(mine & (change | np.concatenate(([True], owner[1:] != owner[:-1]))))
            over = np.flatnonzero(mine & np.concatenate((change[1:] | (owner[1:] != owner[:-1]), [True]))) + 1
        else:
            to.sort()
            own = owner[to]
            cut = (to[1:] != to[:-1] + 1) | (own[1:] != own[:-1]) | change[to[1:]]
            new = to[np.concatenate(([True], cut))]
            over = to[np.concatenate((cut, [True]))] + 1
        base += len(lo)
        opened = ~closed[over]
        lo, hi = new[opened], over[opened]
        closed[hi] = True
    return order, closed[:n]
