"""Searches played to the end: clusters that a task holds whole against tables, few arcs read against all, and jobs that don't grow with the batches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cutweave.operators import table_search
from cutweave.operators.whole_search import NEVER, Whole, play
from tests.test_table_search import MEMBERS, planted, tables

SUMS = ["cut", "volume", "total", "step", "idle", "best", "running"]


def rows_of(state):
    return [sorted(map(tuple, t.select(sorted(t.columns)).collect()), key=str) for t in (state.nodes, state.clusters)]


@pytest.mark.parametrize("whole_arcs", [10**6, 160])
def test_whole_clusters_are_played_as_over_tables(spark, whole_arcs):
    es = planted(links=3, seed=4)
    es = [e for e in es if e[0] < 24 or e[0] % 3]  # the second cluster has fewer arcs, 160 lies between
    arcs, members = tables(spark, es, lambda i: i % 24 < 12 and i % 5 != 2, 50)  # a third cluster of two vertices without arcs
    options = {"tabu": 3, "patience": 10, "width": 4}
    sizes = {r["cluster"]: r["n"] for r in table_search.begin(arcs, members).nodes.groupBy("cluster").agg(F.sum("deg").alias("n")).collect()}
    assert sizes[1] <= 160 < sizes[0] and sizes[2] == 0
    got = rows_of(table_search.finished(table_search.begin(arcs, members), whole_arcs=whole_arcs, **options))
    state = table_search.begin(arcs, members)
    while state.clusters.where("running").take(1):
        state = table_search.batch(state, **options)
    assert got == rows_of(state)


def ring(n, gaps):
    return sorted({(min(i, (i + g) % n), max(i, (i + g) % n)) for i in range(n) for g in gaps})


def whole(es, n, inside, gdeg):
    u, v = np.array([(a, b) for e in es for a, b in (e, e[::-1])]).T
    order = np.lexsort((v, u))
    u, v, inside = u[order], v[order], inside.copy()
    affinity = np.bincount(u, inside[v], n).astype(np.int64)
    cut, volume, total = int((inside[u] & ~inside[v]).sum()), int(gdeg[inside].sum()), int(gdeg.sum())
    low = min(volume, total - volume)
    return Whole(np.searchsorted(u, np.arange(n + 1)), v.astype(np.int32), gdeg, inside, affinity, np.full(n, NEVER), np.zeros(n, bool), cut, volume, total, 0, 0, cut / low if low else float("inf"))


@pytest.mark.parametrize("seed", range(12))
def test_arcs_left_out_of_a_batch_change_nothing(seed):
    rng = np.random.default_rng(seed)
    n = 120
    es = ring(n, [1, 2, 4, 8]) if seed % 2 else sorted({tuple(sorted(rng.choice(n, 2, replace=False))) for _ in range(300)})
    deg = np.bincount(np.array(es).ravel(), minlength=n)
    gdeg = deg + rng.integers(0, 4, n) * (seed % 3 > 0)
    inside = np.arange(n) < 6 if seed % 4 else rng.random(n) < 0.4
    ends = []
    for first in (1, 7, 10**9):
        w = whole(es, n, inside, gdeg)
        batches = play(w, tabu=9, patience=30, width=5, first=first)
        ends.append([batches, *(getattr(w, c) for c in SUMS), *(getattr(w, c).tolist() for c in ("inside", "affinity", "moved_at", "back"))])
    assert ends[0] == ends[1] == ends[2] and ends[0][0] > 2


def test_jobs_dont_grow_with_the_batches(spark):
    n = 160
    es = ring(n, [1, 2, 3])
    arcs = spark.createDataFrame([(a, b) for e in es for a, b in (e, e[::-1])], "u long, v long")
    members = spark.createDataFrame([(i, 0, 6, i == 5) for i in range(n)], MEMBERS)
    w = whole(es, n, np.arange(n) == 5, np.full(n, 6))
    assert play(w, tabu=40, patience=20, width=4) > 20 and w.cut == 12
    spark.sparkContext.setJobGroup("whole-search", "")
    sides = table_search.local_search(arcs, members, tabu=40, patience=20, width=4)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("whole-search"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sides.where("inside").count() == (w.inside ^ w.back).sum() and jobs < 60
