"""The cut-matching game on one cluster, and trimming of what it leaves."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

from cutweave.operators.flow import Net, blocking_rounds

#: Edges of a cluster for which ``sample_potential`` holds its matrix.
SAMPLED_EDGES = 2_000


@dataclass(frozen=True)
class Parameters:
    """Defaults are those of the command line; ``base()`` is the plain configuration."""

    t_const: int = 22
    t_factor: float = 5.0
    min_iterations: int = 0
    min_balance: float = 0.45
    sample_potential: bool = False
    balanced_cut_strategy: bool = True
    use_cut_heuristics: bool = False
    use_balanced_partitions: bool = False
    adaptive: bool = False
    stop_flow_at_fraction: bool = False
    warm_start: bool = False
    trim_with_max_flow_first: bool = False
    krv_step_first: bool = False
    kahan_error: bool = False
    num_flow_vectors: int = 20
    break_at_empty_terminals: bool = True

    @classmethod
    def base(cls) -> "Parameters":
        return cls(num_flow_vectors=1, break_at_empty_terminals=False)

    def iterations(self, m: float) -> int:
        return max(1, self.t_const + math.ceil(self.t_factor * math.log10(m) ** 2)) if m >= 1 else 1


@dataclass
class Cluster:
    """Local vertices 0..n-1 with ids and degrees in the whole graph; edges with an outer end have right = -1."""

    ids: np.ndarray
    gdeg: np.ndarray
    left: np.ndarray
    right: np.ndarray

    @property
    def inner(self) -> np.ndarray:
        return self.right >= 0


@dataclass
class Outcome:
    """kind: balanced, expander, near or fake; ``removed`` masks the vertices on the removed side."""

    kind: str
    removed: np.ndarray
    iterations: int = 0
    congestion: int = 1
    fake: list[tuple[int, int]] = field(default_factory=list)
    potentials: list[float] = field(default_factory=list)


def subdivide(c: Cluster, cap: int) -> Net:
    """Vertices, then one midpoint per edge; midpoints of edges that leave the cluster hang on one end."""
    n, m = len(c.ids), len(c.left)
    mids = np.arange(n, n + m)
    inner = c.inner
    return Net(n + m, np.concatenate([c.left, c.right[inner]]), np.concatenate([mids, mids[inner]]), cap)


def total(x: np.ndarray, exact: bool) -> float:
    """Plain sum, or one without rounding error."""
    return math.fsum(x) if exact else float(x.sum())


def terminals(x: np.ndarray, balanced: bool, exact: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Positions of both sides of the split by deviation from the average, the most extreme ones first."""
    s = len(x)
    d = x - total(x, exact) / s
    low, high = np.flatnonzero(d < 0), np.flatnonzero(d >= 0)
    left, right = (high, low) if len(low) > len(high) else (low, high)
    outward = lambda p: p[np.lexsort((p, -np.abs(d[p])))]
    if total(d[left] ** 2, exact) <= total(d * d, exact) / 20:
        l = total(np.abs(d[left]), exact)
        left, right = np.flatnonzero(d >= 6 * l / s), np.flatnonzero(d <= 4 * l / s)
    left, right = outward(left), outward(right)
    if balanced:
        right = right[: len(left)]
    else:
        left = left[: s // 8]
    return left[: len(right)], right


def median_split(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((np.arange(len(x)), x))
    return order[: len(x) // 2], order[len(x) // 2 :]


def play(c: Cluster, phi: float, p: Parameters, rng: np.random.Generator) -> Outcome:
    """Play until every vector is mixed for T rounds, or enough volume has been cut away.

    Midpoints of the cluster's edges are the terminals; a cut of the flow removes the smaller side.
    """
    n, m = len(c.ids), len(c.left)
    removed = np.zeros(n, bool)
    if m <= 1:
        return Outcome("expander", removed)
    t = p.iterations(max(1, int(c.inner.sum())))
    net = subdivide(c, max(1, math.ceil(1 / phi / t)))
    gdeg = np.concatenate([c.gdeg, np.full(m, 2)])
    volume = int(gdeg.sum())
    lower = volume // 2 // 10 // t
    target = max(lower, int(p.min_balance * volume))
    fake_budget = int(2 * int(c.inner.sum()) / 8 / t)  # of the cluster's own volume, without midpoints
    vectors = rng.standard_normal((p.num_flow_vectors, m))
    vectors -= vectors.mean(axis=1, keepdims=True)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
    if p.sample_potential and m > SAMPLED_EDGES:
        raise ValueError(f"sample_potential holds a row for each edge: {m} edges, at most {SAMPLED_EDGES}")
    matrix = np.eye(m) if p.sample_potential else None
    out = Outcome("expander", removed)
    fake: list[tuple[int, int]] = []
    gone = 0
    while out.iterations < max(t, p.min_iterations) and gone <= target:
        alive = np.flatnonzero(net.alive[n:])
        s = len(alive)
        if s <= 1:
            break
        if matrix is not None:
            part = matrix[alive]
            out.potentials.append(total(((part - part.mean(axis=0)) ** 2).ravel(), True))
        dev = vectors[:, alive] - vectors[:, alive].mean(axis=1, keepdims=True)
        pots = [total(row * row, p.kahan_error) for row in dev]
        best = int(np.argmax(pots))
        if p.adaptive and pots[best] < 1 / (16.0 * s * s * s):
            break
        x = vectors[best, alive]
        left, right = median_split(x) if p.krv_step_first and not gone else terminals(x, p.balanced_cut_strategy, p.kahan_error)
        out.iterations += 1
        if not len(left) or not len(right):
            if p.break_at_empty_terminals:
                break
            continue
        left, right = n + alive[left], n + alive[right]
        net.reset()
        net.absorbed[left], net.sink[right] = 1, 1
        height = max(1, math.ceil(1 / phi / max(math.log10(s), 1e-9)))
        height = min(height, 2 * (n + m) + 1)
        want = min(len(left), len(right))
        if p.stop_flow_at_fraction and len(fake) < fake_budget:
            want -= want // t
        if p.warm_start:
            blocking_rounds(net)
        reached, rest = net.route(height, want if p.stop_flow_at_fraction else None)
        if rest and not (reached and p.stop_flow_at_fraction):
            side = net.level_cut(height, gdeg)
            if side is not None:
                gone += _drop_smaller(net, side, gdeg)
        pairs = net.match(left)
        if rest and reached and p.stop_flow_at_fraction:
            free_l, free_r = np.setdiff1d(left, [a for a, _ in pairs]), np.setdiff1d(right, [b for _, b in pairs])
            more = list(zip(rng.permutation(free_l[net.alive[free_l]]), rng.permutation(free_r[net.alive[free_r]])))
            fake += [(int(a) - n, int(b) - n) for a, b in more]
            pairs += more
        if pairs:
            a, b = np.array(pairs, np.int64).T - n
            for table in [vectors] + ([matrix.T] if matrix is not None else []):
                mean = (table[:, a] + table[:, b]) / 2
                table[:, a], table[:, b] = mean, mean
    ok = net.alive[net.tail] & net.alive[net.head]
    out.congestion = max(1, int(net.congestion[ok].max(initial=0)))
    out.fake = fake
    removed = ~net.alive[:n]
    kept = net.alive[:n].any()
    if kept and removed.any() and int(gdeg[~net.alive].sum()) > lower:
        out.kind, out.removed = "balanced", removed
    elif not removed.any() or not kept:
        out.kind = "fake" if fake else "expander"
    elif fake:
        out.kind = "fake"
    else:
        out.kind, out.removed = "near", removed
    return out


def _drop_smaller(net: Net, side: np.ndarray, gdeg: np.ndarray) -> int:
    """Remove the side of less volume (the complement if equal), then vertices left without a neighbour."""
    other = net.alive & ~side
    small = side if gdeg[side].sum() < gdeg[other].sum() else other
    before = net.alive.copy()
    net.alive[small] = False
    net.alive &= net.degrees() > 0
    return int(gdeg[before & ~net.alive].sum())


def _inner_net(c: Cluster, cap: int) -> Net:
    return Net(len(c.ids), c.left[c.inner], c.right[c.inner], cap)


def trim(c: Cluster, removed: np.ndarray, phi: float, *, max_flow: bool = False) -> np.ndarray:
    """The vertices that trimming keeps of those not ``removed``.

    Every edge lost to the removed side injects 2/phi units next to it; vertices absorb their degree.
    While excess is left, a level cut (or, with ``max_flow``, one minimum cut) goes as well.
    """
    unit = math.ceil(2 / phi)
    net = _inner_net(c, unit)
    net.alive = ~removed
    lost = np.bincount(net.tail[net.alive[net.tail] & removed[net.head]], minlength=net.n)
    net.absorbed, net.sink = lost * unit, c.gdeg.astype(np.int64).copy()
    m = int((net.alive[net.tail] & net.alive[net.head]).sum()) // 2
    height = min(math.ceil(40 * math.log(2 * m + 1) / phi) if m else 1, 2 * net.n + 1)
    if max_flow:
        net.max_flow()
        if net.excess().any():
            net.alive &= ~net.min_cut()
        return net.alive
    while net.alive.any():
        _, rest = net.route(height)
        cut = net.level_cut(height, c.gdeg) if rest else None
        if cut is None:
            break
        if cut.sum() == net.alive.sum():
            break
        beside = net.alive[net.tail] & ~cut[net.tail] & cut[net.head]
        net.absorbed += unit * np.bincount(net.tail[beside], minlength=net.n)
        net.alive &= ~cut
    return net.alive


def trim_fake(c: Cluster, outcome: Outcome, phi: float, rng: np.random.Generator) -> np.ndarray:
    """The vertices that stay after fake matching edges are charged: one minimum cut."""
    net = _inner_net(c, math.ceil(2 / phi))
    net.sink = c.gdeg.astype(np.int64).copy()
    for pair in outcome.fake:
        for e in pair:
            ends = [v for v in (c.left[e], c.right[e]) if v >= 0]
            net.absorbed[ends[int(rng.integers(len(ends)))]] += outcome.iterations
    net.max_flow()
    return net.alive & ~net.min_cut() if net.excess().any() else net.alive
