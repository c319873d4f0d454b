"""Vantage-point trees over fingerprints under (masked) Hamming distance, and union-find, all in numpy.

A node splits points by their distance to a vantage point: at most ``mu`` inside, above it outside. For two points
within ``radius`` of each other the distances to the vantage point differ by at most ``radius`` (triangle bound), so
only points in the band around ``mu`` need a look at the other side. A pair across the split is found once: the inner
point visits the outer side as a query, never the reverse.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

#: Cells of a distance matrix that are held at once.
BLOCK_CELLS = 1 << 21
#: Below so many home points a node is searched in full.
LEAF = 256


def distance(fps: np.ndarray, vantage) -> np.ndarray:
    return np.bitwise_count(fps ^ np.uint64(vantage)).astype(np.int64)


def best_split(home: np.ndarray, asking: np.ndarray, radius: int, tries: int = 6) -> tuple[np.uint64, int, float] | None:
    """The vantage point and mu with the fewest comparisons left, and their share of all; None if no split helps."""
    best = None
    whole = len(home) * (len(home) / 2 + len(asking))
    for at in np.linspace(0, len(home) - 1, tries).astype(int):
        v = home[at]
        h = np.cumsum(np.bincount(distance(home, v), minlength=65))
        q = np.cumsum(np.bincount(distance(asking, v), minlength=65)) if len(asking) else np.zeros(65)
        mu = np.arange(65)
        low, high = np.maximum(mu - radius, -1), np.minimum(mu + radius, 64)
        below = lambda c: np.where(low < 0, 0, c[np.maximum(low, 0)])
        inside, outside = h, h[-1] - h
        cost = inside * (inside / 2 + q[high]) + outside * (outside / 2 + (q[-1] - below(q)) + (h - below(h)))
        cost = np.where((inside == 0) | (outside == 0), np.inf, cost)
        k = int(np.argmin(cost))
        if np.isfinite(cost[k]) and (best is None or cost[k] < best[2]):
            best = (v, k, float(cost[k]))
    return None if best is None else (best[0], best[1], best[2] / max(whole, 1.0))


@dataclass
class Tree:
    """The top of a vantage-point tree; its leaves are shards. Children below 0 are leaves: -1 is shard 0."""

    radius: int
    vantage: list = field(default_factory=list)
    mu: list = field(default_factory=list)
    inner: list = field(default_factory=list)
    outer: list = field(default_factory=list)
    shards: int = 0

    @staticmethod
    def build(sample: np.ndarray, shards: int, radius: int) -> Tree:
        """A tree with about so many shards, balanced on a bounded sample of the fingerprints."""
        tree, none = Tree(radius), np.empty(0, np.uint64)

        def grow(points: np.ndarray, want: int) -> int:
            split = best_split(points, none, radius) if want > 1 and len(points) >= 8 else None
            if split is None or split[2] > 0.9:
                tree.shards += 1
                return -tree.shards
            v, mu, _ = split
            near = distance(points, v) <= mu
            node = len(tree.mu)
            for part in (tree.vantage, tree.mu, tree.inner, tree.outer):
                part.append(0)
            tree.vantage[node], tree.mu[node] = v, mu
            share = max(1, min(want - 1, round(want * near.mean())))
            tree.inner[node] = grow(points[near], share)
            tree.outer[node] = grow(points[~near], want - share)
            return node

        grow(sample, shards)
        return tree

    def route(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index, shard, home): each point's home shard, and the further shards in which it asks for partners."""
        rows = np.arange(len(fps))
        if not self.mu:
            return rows, np.zeros(len(fps), np.int64), np.ones(len(fps), bool)
        out, stack = [], [(0, rows, np.ones(len(fps), bool))]
        while stack:
            node, idx, home = stack.pop()
            if not len(idx):
                continue
            if node < 0:
                out.append((idx, np.full(len(idx), -node - 1), home))
                continue
            d, mu, r = distance(fps[idx], self.vantage[node]), self.mu[node], self.radius
            inner = np.where(home, d <= mu, d <= mu + r)
            own = home & (d > mu)
            asks = (~home & (d > mu - r)) | (home & (d <= mu) & (d > mu - r))
            stack.append((self.inner[node], idx[inner], home[inner]))
            stack.append((self.outer[node], np.concatenate([idx[own], idx[asks]]), np.concatenate([np.ones(own.sum(), bool), np.zeros(asks.sum(), bool)])))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


@dataclass
class Parts:
    """Points dealt by parts of their bits, in place of a tree's top of very many shards, whose bands would overlap in most
    of them: two points within ``radius`` differ in at most so many of radius + 1 parts, so they share one, and each point
    goes to one shard for each part, however many there are."""

    radius: int
    bits: int
    blocks: int

    def route(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index, shard, home), as Tree.route(); every point is at home in each of its shards."""
        n, shards = self.radius + 1, []
        for p in range(n):
            low, high = self.bits * p // n, self.bits * (p + 1) // n
            value = (fps >> np.uint64(low)) & np.uint64((1 << (high - low)) - 1)
            mixed = (value * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
            shards.append(p * self.blocks + (mixed % np.uint64(self.blocks)).astype(np.int64))
        return np.tile(np.arange(len(fps)), n), np.concatenate(shards), np.ones(n * len(fps), bool)


def close_pairs(fps: np.ndarray, home: np.ndarray, radius: int, among: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (i, j) within the radius of which j is a home point, each once, in blocks of bounded size; those of two
    home points only if ``among``."""
    own, asking = np.flatnonzero(home), np.flatnonzero(~home)
    stack = [(own, asking)]
    while stack:
        h, q = stack.pop()
        if not len(h) or len(h) + len(q) < 2:
            continue
        split = best_split(fps[h], fps[q], radius) if len(h) > LEAF else None
        if split is None or split[2] > 0.9:
            yield from _all_pairs(fps, h, q, radius, among)
            continue
        v, mu, _ = split
        dh, dq = distance(fps[h], v), distance(fps[q], v)
        stack.append((h[dh <= mu], q[dq <= mu + radius]))
        near = h[(dh <= mu) & (dh > mu - radius)] if among else h[:0]
        stack.append((h[dh > mu], np.concatenate([q[dq > mu - radius], near])))


def _all_pairs(fps: np.ndarray, h: np.ndarray, q: np.ndarray, radius: int, among: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    cols = min(len(h), 4096)
    rows = max(1, BLOCK_CELLS // cols)
    for c in range(0, len(h), cols):
        part = h[c : c + cols]
        for r in range(0, len(q), rows):
            x, y = np.nonzero(np.bitwise_count(fps[q[r : r + rows], None] ^ fps[None, part]) <= radius)
            if len(x):
                yield q[r + x], part[y]
        for r in range(0, c + len(part) if among else 0, rows):
            block = h[r : min(r + rows, c + len(part))]
            x, y = np.nonzero(np.bitwise_count(fps[block, None] ^ fps[None, part]) <= radius)
            once = r + x < c + y
            if once.any():
                yield block[x[once]], part[y[once]]


class Forest:
    """Union-find over 0..n-1; the root of a set is its smallest member."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        r = self.parent[x]
        while True:
            up = self.parent[r]
            if (up == r).all():
                self.parent[x] = r
                return r
            r = up

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.roots(a), self.roots(b)
            apart = ra != rb
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            low, high = np.minimum(ra[apart], rb[apart]), np.maximum(ra[apart], rb[apart])
            np.minimum.at(self.parent, high, low)


def spanning(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Indices of the edges of a minimum spanning forest (Boruvka rounds; ties by index)."""
    forest, taken = Forest(n), []
    key = w.astype(np.int64) << 32 | np.arange(len(w))
    alive = np.arange(len(w))
    while len(alive):
        ra, rb = forest.roots(a[alive]), forest.roots(b[alive])
        apart = ra != rb
        alive, ra, rb = alive[apart], ra[apart], rb[apart]
        if not len(alive):
            break
        best = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(best, ra, key[alive])
        np.minimum.at(best, rb, key[alive])
        chosen = np.unique(best[best != np.iinfo(np.int64).max]) & 0xFFFFFFFF
        taken.append(chosen)
        forest.union(a[chosen], b[chosen])
    return np.concatenate(taken) if taken else np.empty(0, np.int64)
