"""Expander decomposition: rounds over a work list of clusters instead of a recursion.

In each round all open clusters are split into components (distributed), then every component is
worked on by the cut-matching kernel in a group of its own.  Clusters of up to ``local_arcs`` arcs are
decomposed to the end there; of larger ones one step is made, which gives a final part or two smaller
clusters for the next round, so that those are worked on in parallel.  Clusters with more than ``max_arcs`` arcs are first
cut by distributed PageRank sweeps from several seeds, all such clusters in the same jobs; where no sweep is sparse, the kernel
takes the whole cluster all the same, so that no part is final without the cut-matching game.  ``local_arcs`` only says where a cluster is
played: its random numbers follow from its members, so the parts are the same.
"""

from __future__ import annotations

import logging
import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutweave.functions.storage import discard, materialise, scratch
from cutweave.functions.timing import Phases
from cutweave.operators.components import components
from cutweave.operators.cut_matching import Cluster, Parameters, play, trim, trim_fake
from cutweave.operators.graph import Graph
from cutweave.operators.heuristics import sparse_cut
from cutweave.operators.sweeps import best_sweep_cut, sweep_cut
from cutweave.operators.traversal import personalised_pagerank

log = logging.getLogger("cutweave")
#: Arcs of a cluster above which a distributed sweep is tried before one worker takes it.
MAX_ARCS = 2_000_000
#: Arcs of a cluster that a worker decomposes to the end instead of handing back its two sides.
LOCAL_ARCS = 100_000
_OUT = "id long, child long, final boolean, congestion long, kind string"


def kernel(phi: float, p: Parameters, seed: int, local_arcs: int = LOCAL_ARCS):
    """One cluster -> per vertex: child cluster (its smallest id), is it final, congestion, kind of outcome."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf[pdf["dst"].isna()].drop_duplicates("src").sort_values("src")
        ids, gdeg = v["src"].to_numpy(np.int64), v["gdeg"].to_numpy(np.int64)
        e = pdf[pdf["dst"].notna()]
        src, dst = e["src"].to_numpy(np.int64), e["dst"].to_numpy(np.int64)
        left = np.searchsorted(ids, src)
        at = np.minimum(np.searchsorted(ids, dst), len(ids) - 1)
        right = np.where(ids[at] == dst, at, -1)
        once = (right < 0) | (left < right)  # inner edges come from both ends
        c = in_order(ids, gdeg, left[once], right[once])
        if len(c.left) + int(c.inner.sum()) <= local_arcs:
            label, congestion, kinds = local_decompose(c, phi, p, seed)
            first = np.full(len(congestion), np.iinfo(np.int64).max)
            np.minimum.at(first, label, ids)
            return pd.DataFrame({"id": ids, "child": first[label], "final": True, "congestion": np.array(congestion)[label], "kind": np.array(kinds, object)[label]})
        final, removed, congestion, kind = solve(c, phi, p, stream(seed, ids))
        child = np.empty(len(ids), np.int64)
        for mask in (removed, ~removed):
            if mask.any():
                child[mask] = ids[mask].min()
        return pd.DataFrame({"id": ids, "child": child, "final": final, "congestion": np.where(final, congestion, 0), "kind": kind})

    return work


def in_order(ids: np.ndarray, gdeg: np.ndarray, left: np.ndarray, right: np.ndarray) -> Cluster:
    """A cluster with its edges in an order that follows from its members alone; edges that leave it by one vertex are alike."""
    order = np.lexsort((right, left))
    return Cluster(ids, gdeg, left[order], right[order])


def stream(seed: int, ids: np.ndarray) -> np.random.Generator:
    """Random numbers of a cluster, by its members: the same wherever and in whatever round it is played."""
    return np.random.default_rng([seed, zlib.crc32(np.ascontiguousarray(ids, np.int64).tobytes())])


def solve(c: Cluster, phi: float, p: Parameters, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, int, str]:
    """(which vertices are final, which are on the removed side, congestion of the final part, kind)."""
    n = len(c.ids)
    everything, nothing = np.ones(n, bool), np.zeros(n, bool)
    if n <= 1 or not c.inner.any():
        return everything, nothing, 1, "single"
    if p.use_cut_heuristics:
        gvol = max(2, int(c.gdeg.sum()))
        cut = sparse_cut(c, 1.7 * phi * math.log10(gvol) ** 2, gvol / 10 / p.iterations(gvol), bisection=p.use_balanced_partitions)
        if cut is not None:
            return nothing, cut.side, 0, "heuristic"
    out = play(c, phi, p, rng)
    if out.kind == "balanced":
        return nothing, out.removed, 0, "balanced"
    if out.kind == "expander":
        return everything, nothing, out.congestion, "expander"
    kept = trim_fake(c, out, phi, rng) if out.kind == "fake" else trim(c, out.removed, phi, max_flow=p.trim_with_max_flow_first)
    if not kept.any() or (out.kind == "near" and kept.all()):
        return everything, nothing, 0, out.kind
    return kept, ~kept, 0, out.kind


def local_decompose(c: Cluster, phi: float, p: Parameters, seed: int) -> tuple[np.ndarray, list[int], list[str]]:
    """A cluster's decomposition inside one worker, by a work list: part of each vertex, congestion and kind of each part."""
    label = np.full(len(c.ids), -1)
    congestions: list[int] = []
    kinds: list[str] = []
    todo = [np.arange(len(c.ids))]
    while todo:
        members = todo.pop()
        pieces = _pieces(members, c)
        if len(pieces) > 1:
            todo += pieces
            continue
        inside = np.full(len(c.ids), -1)
        inside[members] = np.arange(len(members))
        a, b = inside[c.left], np.where(c.inner, inside[c.right], -1)
        touch = (a >= 0) | (b >= 0)
        left, right = np.where(a >= 0, a, b)[touch], np.where((a >= 0) & (b >= 0), b, -1)[touch]
        final, removed, congestion, kind = solve(in_order(members, c.gdeg[members], left, right), phi, p, stream(seed, c.ids[members]))
        if final.any():
            label[members[final]] = len(congestions)
            congestions.append(congestion)
            kinds.append(kind)
        if not final.all():
            todo += [x for x in ([members[~final]] if final.any() else [members[removed], members[~removed]]) if len(x)]
    return label, congestions, kinds


def _pieces(members: np.ndarray, c: Cluster) -> list[np.ndarray]:
    """Connected components of the members, by smallest labels."""
    label = np.full(len(c.ids), -1)
    label[members] = members
    e = c.inner & (label[c.left] >= 0) & (label[np.maximum(c.right, 0)] >= 0)
    left, right = c.left[e], c.right[e]
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new[members] = new[new[members]]
        if np.array_equal(new, label):
            break
        label = new
    order = np.argsort(label[members], kind="stable")
    own = label[members][order]
    return np.split(members[order], np.flatnonzero(own[1:] != own[:-1]) + 1)


def decompose(g: Graph, phi: float = 0.001, params: Parameters | None = None, *, seed: int = 555, max_arcs: int = MAX_ARCS, local_arcs: int = LOCAL_ARCS, max_rounds: int = 200, kinds: bool = False, phases: Phases | None = None) -> DataFrame:
    """(id, cluster, congestion): each vertex in exactly one cluster, named by its smallest id.

    ``congestion`` 0 means that the cluster came from trimming and has no certificate; ``kinds`` adds the column kind,
    the outcome that made the cluster final (single, expander, near, fake).  As capacities are whole, 1 / congestion may fall short of ``phi``, to no less than half of it while T <= 1 / phi.
    ``phases`` gets the seconds of each phase.
    """
    params, phases = params or Parameters(), phases or Phases()
    with scratch() as own, phases.time("total"):
        with phases.time("set-up"):
            arcs = materialise(g.arcs(), "decompose-arcs")
            degrees = materialise(g.degrees().select("id", F.col("deg").alias("gdeg")), "decompose-degrees")
            open_ = materialise(degrees.select("id", F.lit(0).cast("long").alias("cluster"), "gdeg"), "decompose-open")
        done: list[DataFrame] = []
        for number in range(max_rounds):
            if not open_.take(1):
                break
            with phases.time("components"):
                ends = open_.select(F.col("id").alias("u"), "cluster")
                other = open_.select(F.col("id").alias("v"), F.col("cluster").alias("cv"))
                tagged = arcs.join(ends, "u").join(other, "v", "left").withColumn("inner", F.coalesce(F.col("cv") == F.col("cluster"), F.lit(False)))
                tagged = materialise(tagged.select("u", "v", "inner"), "decompose-tagged")
                parts = components(tagged.where("inner and u < v").select(F.col("u").alias("a"), F.col("v").alias("b")))
                # A component's smallest id is unique over all clusters, as each vertex is in one cluster.
                label = open_.join(parts, "id", "left").select("id", "gdeg", F.coalesce("component", "id").alias("cluster"))
                label = materialise(label, "decompose-label")
                labelled = tagged.join(label.select(F.col("id").alias("u"), "cluster"), "u")
            with phases.time("sweeps of large clusters"):
                large = materialise(labelled.groupBy("cluster").agg(F.count("*").alias("arcs")).where(F.col("arcs") > max_arcs).select("cluster"), "decompose-large")
                cut = materialise(cut_large(tagged, label.join(large, "cluster", "left_semi"), phi), "decompose-cut") if large.take(1) else None
            with phases.time("cut-matching and trimming"):
                rows = label.select("cluster", F.col("id").alias("src"), F.lit(None).cast("long").alias("dst"), "gdeg")
                rows = rows.unionAll(labelled.select("cluster", F.col("u").alias("src"), F.col("v").alias("dst"), F.lit(0).cast("long").alias("gdeg")))
                if cut is not None:
                    rows = rows.join(cut.select("cluster").distinct(), "cluster", "left_anti")
                found = rows.groupBy("cluster").applyInPandas(kernel(phi, params, seed, local_arcs), _OUT)
                found = materialise(found if cut is None else found.unionAll(cut.drop("cluster")), "decompose-found")
            done.append(found.where("final").select("id", F.col("child").alias("cluster"), "congestion", "kind"))
            rest = materialise(found.where("not final").join(degrees, "id").select("id", F.col("child").alias("cluster"), "gdeg"), "decompose-open")
            log.info("round %d: %d vertices left", number, rest.count())
            for old in (open_, tagged, label):
                discard(old)
            open_ = rest
        else:
            raise RuntimeError(f"not ended after {max_rounds} rounds")
        if not done:
            done = [degrees.select("id", F.col("id").alias("cluster"), F.lit(1).cast("long").alias("congestion"), F.lit("single").alias("kind"))]
        out = done[0]
        for part in done[1:]:
            out = out.unionAll(part)
        return own.keep(materialise(out if kinds else out.drop("kind"), "decompose-done"))


def cut_large(tagged: DataFrame, members: DataFrame, phi: float) -> DataFrame:
    """Sparse cuts of the clusters of ``members(id, cluster, gdeg)``: cluster and the columns of a kernel's result.

    Pushes start from up to four seeds of each cluster: that of the greatest degree, the least id, and the least and the
    greatest hash, and end after 60 rounds, as any scores give a sweep.  Of all sweeps the best is taken, if its conductance is at most 1.7 phi log10(volume)^2; clusters
    without such a sweep have no rows.
    """
    arcs = materialise(tagged.where("inner").join(members.select(F.col("id").alias("u")), "u", "left_semi").select("u", "v"), "decompose-large-arcs")
    deg = materialise(arcs.groupBy(F.col("u").alias("id")).agg(F.count("*").alias("deg")), "decompose-large-degrees")
    h = F.xxhash64("id")
    picks = members.join(deg, "id").groupBy("cluster").agg(F.array_distinct(F.array(F.max_by("id", F.struct("deg", "id")), F.min("id"), F.min_by("id", h), F.max_by("id", h))).alias("seeds"))
    seeds = materialise(picks.select("cluster", F.explode("seeds").alias("seed")), "decompose-seeds")
    scores = personalised_pagerank(arcs, deg, seeds.select("seed"), eps=1e-7, max_rounds=200, rounds=60).select("seed", "id", "p")
    each = members.join(seeds, "cluster").join(scores, ["seed", "id"], "left")  # a cluster has four seeds at most
    ranked = each.select(F.col("seed").alias("cluster"), "id", (F.coalesce("p", F.lit(0.0)) / F.greatest("gdeg", F.lit(1))).alias("score"), "gdeg")
    sweep = materialise(sweep_cut(arcs, ranked), "decompose-sweep")
    best = sweep.join(best_sweep_cut(sweep).select("cluster", "rank"), ["cluster", "rank"])
    best = best.select(F.col("cluster").alias("seed"), "rank", (F.col("cut") / F.least(F.col("volume"), F.col("total") - F.col("volume"))).alias("conductance"))
    best = best.join(seeds, "seed").groupBy("cluster").agg(F.min(F.struct("conductance", "seed", "rank")).alias("b"))
    volume = members.groupBy("cluster").agg(F.greatest(F.lit(2), F.sum("gdeg")).alias("gvol"))
    good = best.join(volume, "cluster").where(F.col("b.conductance") <= F.lit(1.7 * phi) * F.pow(F.log10("gvol"), 2)).select("cluster", F.col("b.seed").alias("seed"), F.col("b.rank").alias("last"))
    sides = sweep.withColumnRenamed("cluster", "seed").join(good, "seed").select("cluster", "id", (F.col("rank") <= F.col("last")).alias("inside"))
    names = sides.groupBy("cluster", "inside").agg(F.min("id").alias("child"))
    out = sides.join(names, ["cluster", "inside"])
    return out.select("cluster", "id", "child", F.lit(False).alias("final"), F.lit(0).cast("long").alias("congestion"), F.lit("large").alias("kind"))
