"""Flow on one cluster as arrays, in bulk-synchronous rounds.

All vertices act at once in a round: those with excess share it out over their admissible arcs
(residual capacity, one height down) by a running sum over each vertex's arcs, and those without an
admissible arc rise to one above their lowest residual neighbour.  As an admissible arc falls by
exactly one height, an arc and its reverse are never both used in a round.  A round costs time in proportion to the
arcs of the vertices that act in it, not to the cluster.
"""

from __future__ import annotations

import numpy as np


class Net:
    """Arcs 2k and 2k+1 are the directions of edge k; flow is antisymmetric between them."""

    def __init__(self, n: int, left: np.ndarray, right: np.ndarray, cap: np.ndarray | int):
        m = len(left)
        tail, head = np.empty(2 * m, np.int64), np.empty(2 * m, np.int64)
        tail[0::2], tail[1::2], head[0::2], head[1::2] = left, right, right, left
        self.order = np.argsort(tail, kind="stable")
        self.starts = np.searchsorted(tail[self.order], np.arange(n + 1))
        self.n, self.tail, self.head = n, tail, head
        self.cap = np.broadcast_to(np.repeat(np.asarray(cap, np.int64), 2) if np.ndim(cap) else np.int64(cap), 2 * m).copy()
        self.flow, self.congestion = np.zeros(2 * m, np.int64), np.zeros(2 * m, np.int64)
        self.alive = np.ones(n, bool)
        self.reset()

    def reset(self) -> None:
        """No flow, sources or sinks; capacities and congestion stay."""
        self.flow[:] = 0
        self.absorbed, self.sink, self.height = np.zeros(self.n, np.int64), np.zeros(self.n, np.int64), np.zeros(self.n, np.int64)

    def excess(self) -> np.ndarray:
        return np.where(self.alive, np.maximum(0, self.absorbed - self.sink), 0)

    def residual(self) -> np.ndarray:
        """Per arc; 0 where an end has been removed."""
        return np.where(self.alive[self.tail] & self.alive[self.head], self.cap - self.flow, 0)

    def degrees(self) -> np.ndarray:
        ok = self.alive[self.tail] & self.alive[self.head]
        return np.bincount(self.tail[ok], minlength=self.n)

    def round(self, bound: int, among: np.ndarray | None = None) -> np.ndarray | None:
        """One round of pushes and relabels below height ``bound``; None if nothing could be done.

        Only the vertices ``among`` (rising ids; all, if None) are looked at.  The result is those that can act in
        the next round: the ones that acted and the ones that got something.
        """
        among = np.arange(self.n) if among is None else among
        left = self.absorbed[among] - self.sink[among]
        active = (left > 0) & (self.height[among] < bound) & self.alive[among]
        acting, left = among[active], left[active]
        if not len(acting):
            return None
        first, count = self.starts[acting], self.starts[acting + 1] - self.starts[acting]
        place = np.repeat(np.arange(len(acting)), count)
        arcs = self.order[np.arange(len(place)) + (first - np.cumsum(count) + count)[place]]
        head = self.head[arcs]
        room = self.cap[arcs] - self.flow[arcs]
        usable = (room > 0) & self.alive[head]
        arcs, head, room, place = arcs[usable], head[usable], room[usable], place[usable]
        down = self.height[acting[place]] == self.height[head] + 1
        stuck = np.ones(len(acting), bool)
        reached = head[down]
        if len(reached):
            a, ar, at = arcs[down], room[down], place[down]
            stuck[at] = False
            before = np.cumsum(ar) - ar
            opens = np.searchsorted(at, at)  # where each vertex's arcs begin
            push = np.minimum(np.maximum(left[at] - (before - before[opens]), 0), ar)
            self.flow[a] += push
            self.flow[a ^ 1] -= push
            np.subtract.at(self.absorbed, acting[at], push)
            np.add.at(self.absorbed, reached, push)
        # Without an admissible arc a vertex rises to one above its lowest residual neighbour.
        if stuck.any():
            lowest = np.full(len(acting), bound - 1, np.int64)
            np.minimum.at(lowest, place, self.height[head])
            up = acting[stuck]
            self.height[up] = np.maximum(self.height[up] + 1, np.minimum(bound, lowest[stuck] + 1))
        return np.unique(np.concatenate([acting, reached]))

    def route(self, bound: int, enough: int | None = None) -> tuple[bool, bool]:
        """Rounds until no vertex below ``bound`` has excess, or ``enough`` is absorbed by sinks.

        Returns (was enough absorbed, is there excess left) and adds the flow to the congestion.
        """
        sinks = np.flatnonzero(self.alive & (self.sink > 0))
        held = lambda: int(np.minimum(self.absorbed[sinks], self.sink[sinks]).sum())
        acting = self.round(bound)
        while acting is not None and not (enough is not None and held() >= enough):
            acting = self.round(bound, acting)
        self.congestion += np.maximum(self.flow, 0)
        return enough is not None and held() >= enough, bool(self.excess().any())

    def routed(self) -> int:
        return int(np.minimum(self.absorbed, self.sink)[self.alive].sum())

    def distances(self, targets: np.ndarray, forward: bool = False) -> np.ndarray:
        """Residual distance of every vertex to ``targets`` (from them, if ``forward``); n where there is none."""
        room = self.residual() > 0
        src, dst = (self.tail[room], self.head[room]) if forward else (self.head[room], self.tail[room])
        dist = np.full(self.n, self.n, np.int64)
        dist[targets] = 0
        step, front = 0, np.zeros(self.n, bool)
        front[targets] = True
        while front.any():
            step += 1
            new = np.zeros(self.n, bool)
            new[dst[front[src]]] = True
            front = new & (dist == self.n)
            dist[front] = step
        return dist

    def max_flow(self) -> int:
        """Send all excess that can reach a sink; the amount that sinks then hold.

        Heights are set to residual distances now and then, so vertices cut off from all sinks
        stop at once; what remains with excess spans a minimum cut.
        """
        while True:
            open_sinks = np.flatnonzero(self.alive & (self.sink > self.absorbed))
            self.height = self.distances(open_sinks)
            if not ((self.excess() > 0) & (self.height < self.n)).any():
                return self.routed()
            acting = None
            for _ in range(max(8, int(self.n**0.5))):
                if (acting := self.round(self.n, acting)) is None:
                    break

    def min_cut(self) -> np.ndarray:
        """After max_flow: mask of the vertices that excess can still reach."""
        return self.alive & (self.distances(np.flatnonzero(self.excess() > 0), forward=True) < self.n)

    def level_cut(self, bound: int, gdeg: np.ndarray) -> np.ndarray | None:
        """Mask of the vertices above the best level, or None: least cut / min(volume, rest) below 1, highest level first."""
        ok = self.alive[self.tail] & self.alive[self.head]
        size = bound + 2
        sign = np.sign(self.height[self.tail[ok]] - self.height[self.head[ok]])
        delta = np.bincount(self.height[self.tail[ok]], sign, size)
        vol = np.bincount(self.height[self.alive], gdeg[self.alive], size)
        cut, volume = np.cumsum(delta[::-1])[::-1], np.cumsum(vol[::-1])[::-1]
        low = np.minimum(volume, vol.sum() - volume)
        level = np.arange(size)
        good = (level >= 1) & (level <= bound) & (cut > 0) & (low > 0)
        ratio = np.where(good, cut / np.maximum(low, 1), np.inf)
        best = size - 1 - int(np.argmin(ratio[::-1]))
        return self.alive & (self.height >= best) if ratio[best] < 1 else None

    def match(self, sources: np.ndarray) -> list[tuple[int, int]]:
        """Disjoint pairs (source, sink) along the flow: a walk takes one unit off each arc that it passes."""
        carry = self.order[(self.flow[self.order] > 0) & self.alive[self.tail[self.order]] & self.alive[self.head[self.order]]]
        cursor = np.searchsorted(self.tail[carry], np.arange(self.n + 1)).tolist()
        ends, head, flow = cursor[1:], self.head[carry].tolist(), self.flow[carry].tolist()
        held = np.minimum(self.absorbed, self.sink).tolist()
        pairs = []
        for s in sources[self.alive[sources]].tolist():
            u = s
            while held[u] <= 0:
                while cursor[u] < ends[u] and flow[cursor[u]] <= 0:
                    cursor[u] += 1
                if cursor[u] >= ends[u]:
                    u = -1
                    break
                a = cursor[u]
                flow[a] -= 1
                u = head[a]
            if u >= 0:
                held[u] -= 1
                pairs.append((s, u))
        return pairs


def blocking_rounds(net: Net, rounds: int = 2) -> int:
    """Warm start: a few phases of shortest residual paths from excess to open sinks; the amount moved."""
    before = net.routed()
    for _ in range(rounds):
        open_sinks = np.flatnonzero(net.alive & (net.sink > net.absorbed))
        net.height = net.distances(open_sinks)
        longest = int(net.height[net.height < net.n].max(initial=0))
        acting = None
        for _ in range(longest + 1):
            if (acting := net.round(min(net.n, longest + 1), acting)) is None:
                break
    net.height[:] = 0
    return net.routed() - before
