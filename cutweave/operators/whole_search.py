"""Batches of moves on one cluster that a task holds whole: those of ``table_search.batch``, one after the other to the end of the search.

A batch reads the vertices once, but arcs only of the candidates that can matter: those of least key first, until the rest can't make the batch better.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Candidates that a batch looks at first, and by how much it looks at more if these don't settle it.
FIRST, MORE = 2048, 4
#: Arcs of a candidate that are read one by one, before the rest of them: most candidates are known by these not to be picked.
PROBES = 8
#: Step of the last move of a vertex that never moved.
NEVER = -(1 << 62)


@dataclass
class Whole:
    """Vertices by id: neighbours of i are ``head[start[i]:start[i + 1]]``.  The rest is as in ``table_search.Search``, of this cluster."""

    start: np.ndarray
    head: np.ndarray
    gdeg: np.ndarray
    inside: np.ndarray
    affinity: np.ndarray
    moved_at: np.ndarray
    back: np.ndarray
    cut: int
    volume: int
    total: int
    step: int
    idle: int
    best: float
    running: bool = True


def conductance(cut: np.ndarray, volume: np.ndarray, total: int) -> np.ndarray:
    """cut / min(volume, rest); NaN where that is 0."""
    low = np.minimum(volume, total - volume)
    return np.divide(cut, low, out=np.full(len(low), np.nan), where=low != 0)


def _arcs_of(w: Whole, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the arcs of ``ids`` among all, and where those of each begin."""
    counts = w.start[ids + 1] - w.start[ids]
    opens = np.cumsum(counts) - counts
    return np.repeat(w.start[ids] - opens, counts) + np.arange(counts.sum()), opens


def play(w: Whole, *, tabu: int, patience: int, width: int, first: int = FIRST) -> int:
    """Plays ``w`` to the end of its search and returns the number of batches."""
    deg = np.diff(w.start)
    dcut = np.where(w.inside, -1, 1) * (deg - 2 * w.affinity)
    dvol = np.where(w.inside, -1, 1) * w.gdeg
    border = np.where(w.inside, w.affinity < deg, w.affinity > 0)
    keys = np.full(len(deg), np.inf)
    batches = 0
    while w.running:
        batches += 1
        able = np.flatnonzero(border & (w.step - w.moved_at > tabu))
        key = conductance(w.cut + dcut[able], w.volume + dvol[able], w.total)
        able, key = able[~np.isnan(key)], key[~np.isnan(key)]
        keys[able] = key
        most = min(width, patience - w.idle)
        picked, cuts, volumes, phi = _picked(w, able, key, keys, dcut, dvol, most, first)
        keys[able] = np.inf
        some = np.flatnonzero(~np.isnan(phi))
        up = some[some < most]
        least = some[np.argmin(phi[some])] if len(some) else None
        better = least is not None and phi[least] < w.best
        if not better and not len(up):
            w.running = False
            break
        last = least if better else up[-1]
        moved = picked[: last + 1]
        at, opens = _arcs_of(w, moved)
        near = w.head[at]
        turn = np.where(w.inside[moved], -1, 1)
        np.add.at(w.affinity, near, np.repeat(turn, np.diff(np.append(opens, len(at)))))
        w.inside[moved] = ~w.inside[moved]
        w.moved_at[moved] = w.step + np.arange(len(moved))
        if better:
            w.best, w.idle = float(phi[last]), 0
            w.back[:] = False
        else:
            w.idle += len(moved)
            w.back[moved] = ~w.back[moved]
        w.cut, w.volume, w.step, w.running = int(cuts[last]), int(volumes[last]), w.step + len(moved), w.idle < patience
        dvol[moved] = -dvol[moved]
        seen = np.concatenate([moved, near])
        inside, affinity = w.inside[seen], w.affinity[seen]
        dcut[seen] = np.where(inside, -1, 1) * (deg[seen] - 2 * affinity)
        border[seen] = np.where(inside, affinity < deg[seen], affinity > 0)
    return batches


def _before(keys: np.ndarray, other: np.ndarray, key: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether ``other`` are candidates that come before ``ids``, whose keys are ``key``."""
    theirs = keys[other]
    return (theirs < key) | ((theirs == key) & (other <= ids))


def _picked(w: Whole, able: np.ndarray, key: np.ndarray, keys: np.ndarray, dcut: np.ndarray, dvol: np.ndarray, most: int, first: int) -> tuple[np.ndarray, ...]:
    """Candidates before all their neighbours, in order, with cuts, volumes and conductances of their prefixes: all, or as many as settle the batch.

    Moving a set changes the cut by the sum of its dcut and the smaller volume by the sum of its abs(dvol) at most.  So if each candidate left out has a
    dcut / abs(dvol) above the least conductance so far, or above the best ever where no prefix is better, no longer prefix comes below it.
    """
    size = np.abs(dvol[able])
    rate = np.where(size > 0, dcut[able] / np.maximum(size, 1), np.where(dcut[able] > 0, np.inf, -np.inf))
    count = first
    while True:
        near = key <= np.partition(key, count - 1)[count - 1] if count < len(key) else np.ones(len(key), bool)
        ids, own = able[near], key[near]
        for k in range(PROBES):
            other = w.head[w.start[ids] + k * (w.start[ids + 1] - w.start[ids]) // PROBES]  # each has an arc, as it is at the border
            free = ~_before(keys, other, own, ids)
            ids, own = ids[free], own[free]
        at, opens = _arcs_of(w, ids)
        lengths = np.diff(np.append(opens, len(at)))
        if len(ids):
            free = ~np.logical_or.reduceat(_before(keys, w.head[at], np.repeat(own, lengths), np.repeat(ids, lengths)), opens)
            ids, own = ids[free], own[free]
        picked = ids[np.argsort(own, kind="stable")]
        cuts, volumes = w.cut + np.cumsum(dcut[picked]), w.volume + np.cumsum(dvol[picked])
        phi = conductance(cuts, volumes, w.total)
        if near.all() or len(picked) >= most and rate[~near].min() > min(np.min(phi, where=~np.isnan(phi), initial=np.inf), w.best):
            return picked, cuts, volumes, phi
        count *= MORE
