"""Flow, trimming and the game over tables against the array kernels and by their invariants, on blocks of few arcs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cutweave.operators import table_flow, table_game
from cutweave.operators.cut_matching import Cluster, Parameters, trim
from cutweave.operators.flow import Net
from cutweave.operators.graph import Graph
from cutweave.sources import generators

BOUND = 7


def instance(seed, n=30, m=60):
    rng = np.random.default_rng(seed)
    es = np.array([(a, b) for a in range(n) for b in range(a + 1, n)])
    es = es[np.sort(rng.permutation(len(es))[:m])]
    cap = rng.integers(1, 4, m)
    offer = np.where(rng.random(n) < 0.3, rng.integers(1, 6, n), 0)
    sink = np.where((offer == 0) & (rng.random(n) < 0.4), rng.integers(1, 4, n), 0)
    return es, cap, offer, sink


def tables(spark, es, cap, offer, sink):
    edges = spark.createDataFrame([(int(a), int(b), int(c)) for (a, b), c in zip(es, cap)], "src long, dst long, cap long")
    return edges, spark.createDataFrame([(i, 0, int(o), int(s), BOUND) for i, (o, s) in enumerate(zip(offer, sink))], "id long, cluster long, absorbed long, sink long, bound long")


def net(es, cap, offer, sink):
    out = Net(len(offer), es[:, 0], es[:, 1], cap)
    out.absorbed, out.sink = offer.astype(np.int64), sink.astype(np.int64)
    return out


def checked(state, es, offer):
    """The nodes by id, after every balance, capacity and reverse has been looked at."""
    arcs = {(r["u"], r["v"]): r for r in state.arcs().collect()}
    nodes = {r["id"]: r for r in state.nodes().collect()}
    assert len(arcs) == 2 * len(es) and all(r["flow"] == -arcs[v, u]["flow"] and abs(r["flow"]) <= r["cap"] for (u, v), r in arcs.items())
    for i, r in nodes.items():
        assert r["absorbed"] == offer[i] - sum(a["flow"] for (u, _), a in arcs.items() if u == i)
    return nodes, arcs


def routed(nodes):
    return sum(min(r["absorbed"], r["sink"]) for r in nodes.values())


@pytest.mark.parametrize("seed, block", [(0, 10**6), (1, 20), (2, 7)])
def test_bounded_flow(spark, seed, block):
    es, cap, offer, sink = instance(seed)
    nodes, arcs = checked(table_flow.route(table_flow.lay_out(*tables(spark, es, cap, offer, sink), block_arcs=block)), es, offer)
    assert all(r["absorbed"] <= r["sink"] or r["height"] == BOUND for r in nodes.values())
    assert all(nodes[u]["height"] <= nodes[v]["height"] + 1 for (u, v), r in arcs.items() if r["cap"] > r["flow"])
    array = net(es, cap, offer, sink)
    array.route(BOUND)
    assert abs(routed(nodes) - array.routed()) <= 1


@pytest.mark.parametrize("seed, block", [(3, 10**6), (4, 12)])
def test_max_flow_and_its_cut(spark, seed, block):
    es, cap, offer, sink = instance(seed)
    state = table_flow.max_flow(table_flow.lay_out(*tables(spark, es, cap, offer, sink), block_arcs=block))
    nodes, _ = checked(state, es, offer)
    assert routed(nodes) == net(es, cap, offer, sink).max_flow()
    side = {r["id"] for r in table_flow.reach(state).collect()}
    over = sum(int(c) for (a, b), c in zip(es, cap) if (a in side) != (b in side))
    assert routed(nodes) == over + sum(int(sink[i] if i in side else offer[i]) for i in range(len(offer)))


def test_blocking_flow_lengthens_the_ways_left(spark):
    es, cap, offer, sink = instance(5)
    state = table_flow.relabel(table_flow.lay_out(*tables(spark, es, cap, offer, sink), block_arcs=15))
    near = lambda s: min((r["height"] for r in s.nodes().where("absorbed > sink").collect()), default=10**9)
    before = near(state)
    array = net(es, cap, offer, sink)
    want = array.distances(np.flatnonzero(array.sink > array.absorbed))
    assert all(min(r["height"], len(offer)) == want[r["id"]] for r in state.nodes().collect())
    state = table_flow.blocking_flow(state)
    nodes, _ = checked(state, es, offer)
    assert routed(nodes) > 0 and {r["height"] for r in nodes.values()} == {0}
    assert near(table_flow.relabel(state)) > before


def test_pairs_are_disjoint_and_as_many_as_units(spark):
    es, cap, _, _ = instance(6)
    offer, sink = np.zeros(30, int), np.zeros(30, int)
    offer[:8], sink[10:18] = 1, 1
    state = table_flow.route(table_flow.lay_out(*tables(spark, es, cap, offer, sink), block_arcs=9), lift=True)
    nodes, _ = checked(state, es, offer)
    pairs = [(r["source"], r["sink"]) for r in table_flow.matched(state, spark.range(8)).collect()]
    assert len(pairs) == routed(nodes) == len({a for a, _ in pairs}) == len({b for _, b in pairs}) > 0
    assert all(a < 8 and 10 <= b < 18 for a, b in pairs)


@pytest.mark.parametrize("block", [10**6, 10])
def test_trimming_keeps_the_planted_part(spark, block):
    """A clique stays; a star beside it loses so many leaves that it goes as a whole."""
    clique = [(a, b) for a in range(8) for b in range(a + 1, 8)]
    star = [(8, 9 + k) for k in range(12)]
    es = np.array(clique + star + [(0, 8)])
    deg = np.bincount(es.ravel())
    gone = np.arange(9, 17)
    members = spark.createDataFrame([(i, 0, int(d)) for i, d in enumerate(deg)], "id long, cluster long, gdeg long")
    edges = spark.createDataFrame([(int(a), int(b)) for a, b in es], "src long, dst long")
    kept = table_flow.trim(edges, members, spark.createDataFrame([(int(g),) for g in gone], "id long"), 0.5, block_arcs=block)
    array = trim(Cluster(np.arange(len(deg)), deg, es[:, 0], es[:, 1]), np.isin(np.arange(len(deg)), gone), 0.5)
    assert sorted(r["id"] for r in kept.collect()) == list(range(8)) == np.flatnonzero(array).tolist()


def test_matrix_potential_equals_the_dense_one(spark):
    rng = np.random.default_rng(7)
    n, dense = 24, np.eye(24)
    matrix = spark.range(n).selectExpr("0L as cluster", "id as eid", "id as col", "1.0D as x")
    for _ in range(3):
        p = rng.permutation(n)[:20].reshape(-1, 2)
        mean = (dense[p[:, 0]] + dense[p[:, 1]]) / 2
        dense[p[:, 0]] = dense[p[:, 1]] = mean
        matrix = table_game.average_rows(matrix, spark.createDataFrame([(0, int(a), int(b)) for a, b in p], "cluster long, a long, b long"))
    alive = np.sort(rng.permutation(n)[:17])
    got = table_game.matrix_potential(matrix, spark.createDataFrame([(0, int(e)) for e in alive], "cluster long, eid long")).first()
    part = dense[np.ix_(alive, alive)]
    assert got["s"] == 17 and got["potential"] == pytest.approx(((part - part.mean(axis=0)) ** 2).sum())


def members_of(g: Graph):
    return g.degrees().select("id", F.lit(0).cast("long").alias("cluster"), F.col("deg").alias("gdeg"))


def test_game_finds_the_planted_cut_round_by_round(spark):
    """Two cliques with one edge between: the level cut of a round takes one of them off."""
    g = generators.clique_path(spark, 6, 2).written()
    p = Parameters(num_flow_vectors=2)
    game, rounds = table_game.begin(g.edges, members_of(g), 0.05, p), 0
    while game.running() and rounds < 4:
        game, rounds = table_game.play(game, p, rounds=1), rounds + 1
    out = table_game.outcomes(game).first()
    assert out["kind"] == "balanced" and out["rounds"] == rounds
    removed = sorted(r["id"] for r in table_game.sides(game).where("removed").collect())
    assert removed in (list(range(6)), list(range(6, 12)))


def test_game_leaves_an_expander_whole_and_mixes(spark):
    g = generators.clique(spark, 7).written()
    p = Parameters(num_flow_vectors=2, sample_potential=True, adaptive=True)
    game = table_game.play(table_game.begin(g.edges, members_of(g), 0.02, p), p, rounds=2)
    out = table_game.outcomes(game).first()
    assert out["kind"] == "expander" and out["gone"] == 0 and out["rounds"] == 2 and 1 / out["congestion"] >= 0.02
    potentials = [r["potential"] for r in game.potentials.orderBy("rounds").collect()]
    assert potentials[0] == pytest.approx(20) and potentials[1] < 20


def test_game_refuses_what_it_does_not_play(spark):
    g = generators.clique(spark, 4)
    with pytest.raises(ValueError):
        table_game.begin(g.edges, members_of(g), 0.02, Parameters(stop_flow_at_fraction=True))
