"""Sparse-cut heuristics on one cluster: nibble sweeps, local search and balanced bisection."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

from cutweave.operators.cut_matching import Cluster


@dataclass
class Cut:
    """A side as a mask, with its cut, the smaller volume and conductance."""

    side: np.ndarray
    cut: int
    volume: int
    conductance: float
    method: str = ""


class Adjacency:
    """Neighbours of the vertices of a cluster, in compressed rows."""

    def __init__(self, c: Cluster):
        l, r = c.left[c.inner], c.right[c.inner]
        u, v = np.concatenate([l, r]), np.concatenate([r, l])
        order = np.argsort(u, kind="stable")
        self.n, self.tail, self.head = len(c.ids), u[order], v[order]
        self.start = np.searchsorted(self.tail, np.arange(self.n + 1))
        self.deg, self.gdeg = np.diff(self.start), c.gdeg.astype(np.int64)
        self.total = int(self.gdeg.sum())

    def of(self, u: int) -> np.ndarray:
        return self.head[self.start[u] : self.start[u + 1]]

    def measure(self, side: np.ndarray, method: str = "") -> Cut:
        cut = int((side[self.tail] & ~side[self.head]).sum())
        vol = int(self.gdeg[side].sum())
        low = min(vol, self.total - vol)
        return Cut(side, cut, low, cut / low if low else float("inf"), method)


def pagerank(a: Adjacency, seed: int, alpha: float = 0.1, eps: float = 1e-9) -> np.ndarray:
    """Lazy pushes of all active vertices at once until every residual is below eps * degree."""
    p, r = np.zeros(a.n), np.zeros(a.n)
    r[seed] = 1.0
    while True:  # each push takes a share alpha of a residual away, so this ends
        active = (a.deg > 0) & (r >= eps * a.deg)
        if not active.any():
            break
        moved = np.where(active, r, 0.0)
        p += alpha * moved
        share = (1 - alpha) * moved / 2
        r = r - moved + share + np.bincount(a.head, (share / np.maximum(a.deg, 1))[a.tail], a.n)
    return p


def sweep(a: Adjacency, score: np.ndarray, method: str = "nibble", balance: float = 0.0) -> Cut | None:
    """Best prefix by descending score (positive scores only); those below ``balance`` in volume don't count."""
    inside = np.flatnonzero(score > 0)
    order = inside[np.lexsort((inside, -score[inside]))]
    if not len(order):
        return None
    rank = np.full(a.n, a.n, np.int64)
    rank[order] = np.arange(len(order))
    gain = np.bincount(rank[a.tail], np.where(rank[a.head] > rank[a.tail], 1, -1) * (rank[a.head] != rank[a.tail]), a.n + 1)[: len(order)]
    cut, vol = np.cumsum(gain), np.cumsum(a.gdeg[order])
    low = np.minimum(vol, a.total - vol)
    ratio = np.where(low > max(0, balance), cut / np.maximum(low, 1), np.inf)
    best = int(np.argmin(ratio))
    if not np.isfinite(ratio[best]):
        return None
    side = np.zeros(a.n, bool)
    side[order[: best + 1]] = True
    return a.measure(side, method)


def local_search(a: Adjacency, side: np.ndarray, *, tabu: int = 500, patience: int = 300) -> Cut:
    """Moves the vertex whose change lowers conductance most, even uphill, and keeps the best state seen.

    A moved vertex rests for ``tabu`` moves; the search ends after ``patience`` moves without a
    better state.  Keys in the heap may be stale; they are renewed when they come up.
    """
    side = side.copy()
    inside = np.bincount(a.tail, side[a.head], a.n).astype(np.int64)  # neighbours inside
    cut, vol = int((a.deg - inside)[side].sum()), int(a.gdeg[side].sum())
    phi = lambda c, v: c / min(v, a.total - v) if min(v, a.total - v) > 0 else float("inf")

    def after(u: int) -> float:
        s = -1 if side[u] else 1
        return phi(cut + s * (a.deg[u] - 2 * inside[u]), vol + s * a.gdeg[u])

    best, best_side, moved_at = phi(cut, vol), side.copy(), np.full(a.n, -tabu - 1, np.int64)
    border = np.unique(np.concatenate([a.tail[side[a.tail] != side[a.head]], np.flatnonzero(side)[:1]])) if a.n else []
    heap = [(after(u), int(u)) for u in border]
    heapq.heapify(heap)
    step = idle = 0
    waiting: list[tuple[int, int]] = []
    while idle < patience and (heap or waiting):
        while waiting and waiting[0][0] <= step:
            u = waiting.pop(0)[1]
            heapq.heappush(heap, (after(u), u))
        if not heap:
            break
        key, u = heapq.heappop(heap)
        if step - moved_at[u] <= tabu:
            continue
        now = after(u)
        if now > key + 1e-15 and heap and now > heap[0][0]:
            heapq.heappush(heap, (now, u))
            continue
        if not np.isfinite(now):
            idle += 1
            continue
        s = -1 if side[u] else 1
        cut, vol = int(cut + s * (a.deg[u] - 2 * inside[u])), int(vol + s * a.gdeg[u])
        side[u] = not side[u]
        near = a.of(u)
        np.add.at(inside, near, s)
        moved_at[u] = step
        waiting.append((step + tabu + 1, u))
        step += 1
        for v in near:
            heapq.heappush(heap, (after(int(v)), int(v)))
        if (p := phi(cut, vol)) < best - 1e-15:
            best, best_side, idle = p, side.copy(), 0
        else:
            idle += 1
    return a.measure(best_side, "local search")


def bisect(a: Adjacency, *, imbalance: float = 1.2, rounds: int = 100, seed: int = 0) -> Cut | None:
    """Spectral order by power iteration on the lazy walk, then the best prefix with both sides within the imbalance."""
    if a.n < 2 or not a.total:
        return None
    d = np.maximum(a.deg, 1).astype(float)
    x = np.random.default_rng(seed).standard_normal(a.n)
    for _ in range(rounds):
        x -= (x * d).sum() / d.sum()
        x = x / 2 + np.bincount(a.tail, x[a.head], a.n) / d / 2
        x /= max(np.abs(x).max(), 1e-300)
    return sweep(a, x - x.min() + 1e-9, "bisection", balance=a.total * (1 - imbalance / 2))


def sparse_cut(c: Cluster, goal: float, balance: float, *, bisection: bool = False, trials: int = 10, seed: int = 555) -> Cut | None:
    """The best of several seeded nibble and local-search cuts whose smaller volume reaches ``balance``.

    None if its conductance is above ``goal``.
    """
    a = Adjacency(c)
    if a.n < 2:
        return None
    if bisection and (found := bisect(a, seed=seed)) and found.conductance < goal and found.volume >= balance:
        return found
    rng, best = np.random.default_rng(seed), None
    for _ in range(trials):
        s = int(rng.integers(a.n))
        score = pagerank(a, s) / np.maximum(a.gdeg, 1)
        cuts = [sweep(a, score)]
        cuts.append(local_search(a, cuts[0].side if cuts[0] else np.arange(a.n) == s))
        for cut in cuts:
            if cut and cut.volume >= balance and cut.volume > 0 and (best is None or cut.conductance < best.conductance):
                best = cut
    return best if best and best.conductance <= goal else None
