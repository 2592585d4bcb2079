"""Signature trees over sets: nodes hold the OR of their sets' bitmaps and the range of their sizes; a dual traversal leaves out pairs of nodes that cannot overlap enough."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

FANOUT = 8
#: Bits of a bitmap for each element of the set, at least, and the bounds of its length, as powers of two.
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 9, 20
#: 64-bit words that one step compares.
STEP_WORDS = 1 << 20


def bits_for(size: int) -> int:
    """log2 of the length of the bitmap of a set of this size."""
    return min(MOST_BITS, max(LEAST_BITS, (BITS_EACH * size - 1).bit_length()))


def bitmap(elements: np.ndarray, log_bits: int) -> np.ndarray:
    """The bitmap of 64-bit elements, as 64-bit words: element e sets bit e mod 2**log_bits."""
    flags = np.zeros(1 << log_bits, bool)
    flags[(elements & np.uint64((1 << log_bits) - 1)).astype(np.int64)] = True
    return np.packbits(flags, bitorder="little").view(np.uint64)


def widened(words: np.ndarray, n: int) -> np.ndarray:
    """A bitmap as one of n words: an element's bit in the longer one is among those that repeat its bit in the shorter."""
    return words if len(words) == n else np.tile(words, n // len(words))


class SignatureTree:
    """Entries with bitmaps of one length, sizes in [lo, hi], and `spare`: the most elements of one of its sets that share a bit with another."""

    def __init__(self, lo: np.ndarray, hi: np.ndarray, spare: np.ndarray, bits: np.ndarray, tag: np.ndarray):
        self.levels = [(lo, hi, spare, bits, tag, tag)]
        while len(self.levels[-1][0]) > 1:
            self._grow()

    def _grow(self) -> None:
        lo, hi, spare, bits, low, high = self.levels[-1]
        at = np.arange(0, len(lo), FANOUT)
        fold = lambda f, x: f.reduceat(x, at)
        self.levels.append((fold(np.minimum, lo), fold(np.maximum, hi), fold(np.maximum, spare), np.bitwise_or.reduceat(bits, at, axis=0), fold(np.minimum, low), fold(np.maximum, high)))

    def reach(self, height: int) -> None:
        while len(self.levels) < height:
            self._grow()


def possible(a: tuple, b: tuple, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs (a[i], b[j]) may hold two sets of unlike tags with 100 * overlap >= 80 * union.

    Such sets a and b have sizes within 4 : 5 and an overlap of (a + b) * 4 / 9 at least; elements that two sets share
    set common bits, but for those that share a bit within the smaller.
    """
    ok = (5 * a[1][i] >= 4 * b[0][j]) & (5 * b[1][j] >= 4 * a[0][i]) & ~((a[4][i] == a[5][i]) & (b[4][j] == b[5][j]) & (a[4][i] == b[4][j]))
    at = np.flatnonzero(ok)
    step = max(1, STEP_WORDS // a[3].shape[1])
    for k in range(0, len(at), step):
        own = at[k : k + step]
        x, y = i[own], j[own]
        common = np.bitwise_count(a[3][x] & b[3][y]).sum(1, dtype=np.int64) + np.minimum(a[2][x], b[2][y])
        ok[own] = 9 * common >= 4 * (a[0][x] + b[0][y])
    return ok


def dual(a: SignatureTree, b: SignatureTree | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of entries (i of a, j of b) that may link, in steps; without b, pairs i < j of a."""
    same, b = b is None, b or a
    height = max(len(a.levels), len(b.levels))
    a.reach(height)
    b.reach(height)
    one = np.zeros(1, np.int64)
    todo = [(height - 1, one, one)]
    ramp = np.arange(FANOUT)
    while todo:
        level, i, j = todo.pop()
        keep = possible(a.levels[level], b.levels[level], i, j)
        if same and level == 0:
            keep &= i < j
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        if level == 0:
            yield i, j
            continue
        x = np.repeat((i[:, None] * FANOUT + ramp), FANOUT, axis=1).ravel()
        y = np.tile((j[:, None] * FANOUT + ramp), (1, FANOUT)).ravel()
        keep = (x < len(a.levels[level - 1][0])) & (y < len(b.levels[level - 1][0]))
        if same:
            keep &= x <= y
        x, y = x[keep], y[keep]
        for k in range(0, len(x), 1 << 16):
            todo.append((level - 1, x[k : k + (1 << 16)], y[k : k + (1 << 16)]))


def near_pairs(lo: np.ndarray, hi: np.ndarray, spare: np.ndarray, bits: list[np.ndarray], tag: np.ndarray, order: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of entries that may link, by trees over entries with bitmaps of one length, each pair of trees once; order: how entries follow in a tree."""
    length = np.array([len(x) for x in bits], np.int64)
    trees = []
    for n in np.unique(length).tolist():
        own = order[length[order] == n]
        trees.append((n, own, lambda own=own, n=n, to=None: SignatureTree(lo[own], hi[own], spare[own], np.stack([widened(bits[k], to or n) for k in own.tolist()]), tag[own])))
    for p, (n, own, make) in enumerate(trees):
        tree = make()
        for i, j in dual(tree):
            yield own[i], own[j]
        for m, other, make_other in trees[p + 1 :]:
            if 5 * hi[own].max() >= 4 * lo[other].min() and 5 * hi[other].max() >= 4 * lo[own].min():
                for i, j in dual(make(to=m), make_other()):
                    yield own[i], other[j]


class Links:
    """Union-find over the entries of a group; starts from their components, and notes each link that joins two."""

    def __init__(self, components: np.ndarray):
        first: dict[int, int] = {}
        self.parent = [first.setdefault(c, k) for k, c in enumerate(components.tolist())]
        self.found: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def add(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
            self.found.append((i, j))

    def roots(self) -> np.ndarray:
        return np.array([self.root(i) for i in range(len(self.parent))], np.int64)


def links_at(overlap: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 100 * overlap >= 80 * (a + b - overlap)


def linked(sets: list[np.ndarray], components: np.ndarray) -> list[tuple[int, int]]:
    """Links (i, j) that join the components of what links among sorted sets of unlike components; few pairs are looked at one by one.

    First sets are held as pivots against all others at once, as long as that links many; then the trees give the
    pairs that may link, and those whose components are still apart are verified.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    links = Links(components)

    def verify(i: int, j: int) -> None:
        if links.root(i) != links.root(j) and links_at(len(np.intersect1d(sets[i], sets[j], assume_unique=True)), size[i], size[j]):
            links.add(i, j)

    if n <= 6:
        for i in range(n):
            for j in range(i + 1, n):
                if 5 * min(size[i], size[j]) >= 4 * max(size[i], size[j]):
                    verify(i, j)
        return links.found
    flat, starts = np.concatenate(sets), np.concatenate(([0], np.cumsum(size)[:-1]))
    pivot, linked_by_it = 0, n
    for _ in range(16):
        own = sets[pivot]
        hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
        near = np.flatnonzero(links_at(np.add.reduceat(hit.astype(np.int64), starts), size, size[pivot]))
        before = len(links.found)
        for k in near.tolist():
            links.add(pivot, k)
        linked_by_it = len(links.found) - before
        apart = np.flatnonzero(links.roots() != links.root(pivot))
        if not len(apart) or 20 * linked_by_it < n:
            break
        pivot = int(apart[len(apart) // 2])
    roots = links.roots()
    if (roots == roots[0]).all():
        return links.found
    lone = np.bincount(roots, minlength=n)[roots] == 1
    order = np.lexsort((size, np.where(lone, 0, roots), lone))
    bits = [bitmap(s, bits_for(len(s))) for s in sets]
    spare = size - np.array([int(np.bitwise_count(b).sum()) for b in bits])
    for i, j in near_pairs(size, size, spare, bits, roots, order):
        for x, y in zip(i.tolist(), j.tolist()):
            verify(x, y)
    return links.found
