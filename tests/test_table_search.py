"""Local search, bisection and the best of several cuts over tables, against a search of one process and planted cuts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cutweave.functions.storage import bucketed, discard
from cutweave.operators import table_search

MEMBERS = "id long, cluster long, gdeg long, inside boolean"


def planted(n=12, clusters=2, links=1, seed=0):
    """Two dense halves of n vertices a cluster, joined by ``links`` edges; an edge between the clusters."""
    rng, es = np.random.default_rng(seed), set()
    for c in range(clusters):
        base = 2 * n * c
        for half in (0, n):
            es |= {(base + half + i, base + half + j) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.7 or j == i + 1}
        es |= {(base + i, base + n + i) for i in range(links)}
    return sorted(es | {(0, 2 * n)} if clusters > 1 else es)


def tables(spark, es, side, n_ids):
    arcs = spark.createDataFrame([(a, b) for e in es for a, b in (e, e[::-1])], "u long, v long")
    deg = np.bincount(np.array(es).ravel(), minlength=n_ids)
    size = 24
    return arcs, spark.createDataFrame([(i, i // size, int(deg[i]), bool(side(i))) for i in range(n_ids)], MEMBERS)


def sides_of(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["cluster"], {}).setdefault(r["inside"], set()).add(r["id"])
    return {c: set(map(frozenset, s.values())) for c, s in out.items()}


HALVES = {c: {frozenset(range(24 * c, 24 * c + 12)), frozenset(range(24 * c + 12, 24 * c + 24))} for c in (0, 1)}


def one_batch(es, members, state, tabu, patience, width):
    """The batch of one cluster by its definition, in plain Python; state is changed."""
    ids = {i for i, _, _, _ in members}
    gdeg = {i: g for i, _, g, _ in members}
    near = {i: [b for e in es for a, b in (e, e[::-1]) if a == i and b in ids] for i in ids}
    total = sum(gdeg.values())

    def phi(side):
        low = min(sum(gdeg[i] for i in side), total - sum(gdeg[i] for i in side))
        return sum(j not in side for i in side for j in near[i]) / low if low else None

    side = state["side"]
    able = {}
    for i in ids:
        border = any((j in side) != (i in side) for j in near[i])
        rested = i not in state["moved"] or state["step"] - state["moved"][i] > tabu
        if border and rested and phi(side ^ {i}) is not None:
            able[i] = (phi(side ^ {i}), i)
    picked = sorted((k for i, k in able.items() if all(able[j] > k for j in near[i] if j in able)))
    if not picked or not state["running"]:
        state["running"] = False
        return
    now, seen = set(side), []
    for _, i in picked:
        now = now ^ {i}
        seen.append(phi(now))
    best = min((p, r) for r, p in enumerate(seen, 1) if p is not None)
    better = best[0] < state["best"]
    take = best[1] if better else max(r for r, p in enumerate(seen, 1) if p is not None and r <= min(width, patience - state["idle"]))
    for r, (_, i) in enumerate(picked[:take]):
        side ^= {i}
        state["moved"][i] = state["step"] + r
    state["step"] += take
    state["idle"] = 0 if better else state["idle"] + take
    if better:
        state["best"], state["best_side"] = best[0], set(side)
    state["running"] = state["idle"] < patience


@pytest.mark.parametrize("tabu, width", [(3, 2), (30, 5)])
def test_batches_equal_their_definition(spark, tabu, width):
    es = planted(links=3, seed=4)
    arcs, members = tables(spark, es, lambda i: i % 24 < 12 and i % 5 != 2 or i % 24 in (13, 20), 48)
    rows = {c: [tuple(r) for r in members.where(F.col("cluster") == c).collect()] for c in (0, 1)}
    state, plain = table_search.begin(arcs, members), {}
    for c, m in rows.items():
        best = state.clusters.where(F.col("cluster") == c).first()["best"]
        side = {i for i, _, _, s in m if s}
        plain[c] = {"side": side, "best_side": set(side), "moved": {}, "step": 0, "idle": 0, "best": best, "running": True}
    for _ in range(5):
        state = table_search.batch(state, tabu=tabu, patience=20, width=width)
        for c in (0, 1):
            one_batch(es, rows[c], plain[c], tabu, 20, width)
            got = state.clusters.where(F.col("cluster") == c).first()
            assert (got["step"], got["idle"], got["running"]) == (plain[c]["step"], plain[c]["idle"], plain[c]["running"]) and got["best"] == pytest.approx(plain[c]["best"], abs=1e-15)
            assert {r["id"] for r in state.nodes.where((F.col("cluster") == c) & F.col("inside")).collect()} == plain[c]["side"]
            assert {r["id"] for r in table_search.best_sides(state).where((F.col("cluster") == c) & F.col("inside")).collect()} == plain[c]["best_side"]
        assert all(r["affinity_errors"] == 0 and r["sum_errors"] == 0 for r in table_search.errors(state).collect())


def test_many_candidates_move_as_few_do(spark):
    """With candidates dealt by ranges a batch does the same, and no table of vertices is broadcast."""
    arcs, members = tables(spark, planted(links=3, seed=4), lambda i: i % 24 < 12 and i % 5 != 2, 48)
    got = []
    for few in (0, 1_000):
        state = table_search.begin(arcs, members)
        for _ in range(3):
            state = table_search.batch(state, tabu=3, patience=20, width=2, few=few)
        got.append([sorted(map(tuple, t.collect()), key=str) for t in (state.nodes, state.clusters)])
    assert got[0] == got[1]
    inner = table_search.inner_arcs(arcs, members)
    assert "Broadcast" not in inner._jdf.queryExecution().executedPlan().toString()


def test_search_and_bisection_find_planted_halves(spark):
    arcs, members = tables(spark, planted(), lambda i: (i % 24 < 12) != (i % 24 in (3, 17)), 48)
    assert sides_of(table_search.local_search(arcs, members, patience=6, width=6)) == HALVES
    assert sides_of(table_search.bisect(arcs, members, rounds=30)) == HALVES
    found = {r["cluster"]: r for r in table_search.measured(arcs, members, table_search.bisect(arcs, members, rounds=30)).collect()}
    assert all(r["cut"] == 1 for r in found.values()) and len(found) == 2


def test_scores_dont_depend_on_partitions(spark):
    arcs, members = tables(spark, planted(seed=2), lambda i: False, 48)
    arcs = table_search.inner_arcs(arcs, members)
    one = {r["id"]: r["score"] for r in table_search.spectral_order(arcs.coalesce(1), members, rounds=7).collect()}
    many = {r["id"]: r["score"] for r in table_search.spectral_order(arcs.repartition(9), members.repartition(5), rounds=7).collect()}
    assert one == many and len(set(one.values())) > 24


def test_no_cut_and_no_rows(spark):
    arcs = spark.createDataFrame([(0, 1), (1, 0)], "u long, v long")
    members = spark.createDataFrame([(0, 0, 1, True), (1, 0, 1, True), (2, 2, 0, True)], MEMBERS)  # one side is empty; a lone vertex
    state = table_search.batch(table_search.begin(arcs, members))
    assert not state.clusters.where("running").take(1)
    empty = members.limit(0)
    assert table_search.bisect(arcs.limit(0), empty, rounds=1).count() == 0
    assert table_search.local_search(arcs.limit(0), empty).count() == 0
    goals = members.select("cluster").distinct().select("cluster", F.lit(0.0).alias("goal"), F.lit(1).alias("balance"))
    assert table_search.sparse_cuts(arcs, members, goals, trials=0).count() == 0


def test_best_of_several_cuts(spark):
    arcs, members = tables(spark, planted(), lambda i: False, 48)
    goals = spark.createDataFrame([(0, 1.0, 1), (1, 1e-9, 1)], "cluster long, goal double, balance long")
    out = table_search.sparse_cuts(arcs, members, goals, bisection=True, trials=0)
    assert sides_of(out) == {0: HALVES[0]}  # nothing is below the second goal
    assert {r["method"] for r in out.select("method").distinct().collect()} == {"bisection"}


def test_bucketed_tables_are_dropped(spark):
    before = len(spark.catalog.listTables())
    df = bucketed(spark.range(20).withColumnRenamed("id", "v"), "few", "v")
    assert df.count() == 20 and "Exchange" not in df.groupBy("v").count()._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "")
    discard(df)
    assert len(spark.catalog.listTables()) == before
