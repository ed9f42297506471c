"""Flow, cut-matching, trimming, heuristics and whole decompositions: invariants and planted structure."""

import itertools

import numpy as np
import pytest

from cutweave.operators.cut_matching import Cluster, Parameters, play, terminals, trim
from cutweave.operators.decompose import decompose
from cutweave.operators.flow import Net
from cutweave.operators.graph import Graph
from cutweave.operators.heuristics import Adjacency, bisect, local_search, pagerank, sparse_cut, sweep
from cutweave.operators.traversal import personalised_pagerank
from cutweave.sources import generators


def random_net(seed, n=8, m=16):
    rng = np.random.default_rng(seed)
    es = np.array([e for e in itertools.combinations(range(n), 2)])
    es = es[rng.permutation(len(es))[:m]]
    net = Net(n, es[:, 0], es[:, 1], rng.integers(1, 4, m))
    net.absorbed[:3] = rng.integers(0, 6, 3)
    net.sink[4:] = rng.integers(0, 3, n - 4)
    return net


@pytest.mark.parametrize("seed", range(12))
def test_max_flow_is_min_cut(seed):
    net = random_net(seed)
    source, sink = net.absorbed.copy(), net.sink.copy()
    value = net.max_flow()
    assert (net.flow[0::2] == -net.flow[1::2]).all() and (net.flow <= net.cap).all() and net.absorbed.sum() == source.sum() and (net.absorbed >= 0).all()
    best = min(
        sum(net.cap[a] for a in range(len(net.cap)) if s >> int(net.tail[a]) & 1 and not s >> int(net.head[a]) & 1) + sum(int(sink[v]) if s >> v & 1 else int(source[v]) for v in range(net.n)) for s in range(1 << net.n)
    )
    assert value == best
    if net.excess().any():
        side = net.min_cut()
        cut = net.cap[side[net.tail] & ~side[net.head]].sum() + sink[side].sum() + source[~side].sum()
        assert cut == best


@pytest.mark.parametrize("seed", range(6))
def test_bounded_flow_and_matching(seed):
    net = random_net(seed)
    net.absorbed[:], net.sink[:] = 0, 0
    net.absorbed[:3], net.sink[4:7] = 1, 1
    net.route(30)
    assert (net.flow[0::2] == -net.flow[1::2]).all() and (net.flow <= net.cap).all() and net.absorbed.sum() == 3
    pairs = net.match(np.arange(3))
    assert len(pairs) == net.routed() == len({a for a, _ in pairs}) == len({b for _, b in pairs})
    assert all(net.sink[b] for _, b in pairs)


def cluster(g: Graph) -> Cluster:
    e = np.array(sorted((r["src"], r["dst"]) for r in g.edges.collect()))
    n = g.vertices.count()
    return Cluster(np.arange(n), np.bincount(e.ravel(), minlength=n), e[:, 0], e[:, 1])


def test_level_cut_finds_the_planted_side(spark):
    c = cluster(generators.clique_path(spark, 6, 2))
    net = Net(12, c.left, c.right, 1)
    net.height[:6] = 3
    assert net.level_cut(5, c.gdeg).tolist() == [True] * 6 + [False] * 6


def test_terminals_are_disjoint():
    rng = np.random.default_rng(0)
    for balanced in (True, False):
        for _ in range(20):
            l, r = terminals(rng.standard_normal(41) ** 3, balanced)
            assert not set(l) & set(r) and len(l) <= len(r)


def test_play_on_expander_and_planted_cut(spark):
    p = Parameters(num_flow_vectors=5)
    out = play(cluster(generators.clique(spark, 20)), 0.01, p, np.random.default_rng(1))
    assert out.kind == "expander" and not out.removed.any() and 1 / out.congestion >= 0.01
    out = play(cluster(generators.clique_path(spark, 20, 2)), 0.01, p, np.random.default_rng(1))
    assert out.kind == "balanced" and sorted(np.flatnonzero(out.removed) // 20) in ([0] * 20, [1] * 20)


def test_trim_keeps_an_expander(spark):
    c = cluster(generators.clique_path(spark, 20, 2))
    removed = np.arange(40) >= 20
    for max_flow in (False, True):
        kept = trim(c, removed, 0.05, max_flow=max_flow)
        assert kept.any() and not (kept & removed).any()


def test_heuristics_find_the_planted_cut(spark):
    c = cluster(generators.clique_path(spark, 10, 2))
    a = Adjacency(c)
    for cut in (sweep(a, pagerank(a, 3) / a.gdeg), local_search(a, np.arange(20) < 8), bisect(a), sparse_cut(c, 1.0, 1)):
        assert cut.cut == 1 and cut.side.sum() == 10
        assert cut.conductance == pytest.approx(1 / 91)
    best = min((a.measure(np.array(s)).conductance for s in itertools.product([False, True], repeat=8)), default=1) if a.n == 8 else 0
    assert cut.conductance >= best


def test_rounds_equal_planted_parts(spark):
    got = decompose(generators.clique_path(spark, 20, 3), 0.01, Parameters(num_flow_vectors=5), local_arcs=0)
    assert {r["id"]: r["cluster"] for r in got.collect()} == {i: i - i % 20 for i in range(60)}


@pytest.mark.parametrize("options", [{}, {"use_cut_heuristics": True}, {"adaptive": True, "warm_start": True, "stop_flow_at_fraction": True}, {"krv_step_first": True, "trim_with_max_flow_first": True, "kahan_error": True}])
def test_decompose_clique_path(spark, options):
    g = generators.clique_path(spark, 20, 5)
    got = {r["id"]: (r["cluster"], r["congestion"]) for r in decompose(g, 0.01, Parameters(num_flow_vectors=5, **options)).collect()}
    assert {i: c for i, (c, _) in got.items()} == {i: i - i % 20 for i in range(100)}


def test_decompose_edges(spark):
    lone = Graph(spark.range(3), spark.createDataFrame([], "src long, dst long"))
    assert sorted(tuple(r) for r in decompose(lone).collect()) == [(0, 0, 1), (1, 1, 1), (2, 2, 1)]
    one = Graph.from_pairs(spark.createDataFrame([(0, 1)], "u long, v long"))
    assert sorted(tuple(r) for r in decompose(one).collect()) == [(0, 0, 1), (1, 0, 1)]
    assert decompose(Graph(spark.range(0), spark.createDataFrame([], "src long, dst long"))).count() == 0
    two = Graph.from_pairs(spark.createDataFrame([(0, 1), (1, 2), (0, 2), (5, 6), (6, 7), (5, 7)], "u long, v long"))
    assert {r["cluster"] for r in decompose(two).collect()} == {0, 5}


def test_large_clusters_are_cut_by_sweeps(spark):
    g = generators.clique_path(spark, 20, 4)
    got = decompose(g, 0.01, Parameters(num_flow_vectors=5), max_arcs=500, local_arcs=300)
    assert {r["id"]: r["cluster"] for r in got.collect()} == {i: i - i % 20 for i in range(80)}


def test_a_cut_that_the_sweep_misses_is_found_by_the_game(spark, monkeypatch):
    at = "cutweave.operators.decompose."
    monkeypatch.setattr(at + "personalised_pagerank", lambda arcs, deg, seed, **_: seed.selectExpr("seed", "seed as id", "1.0D as p", "0.0D as r"))
    monkeypatch.setattr(at + "best_sweep_cut", lambda sweep: sweep.limit(0))
    got = decompose(generators.clique_path(spark, 20, 2), 0.01, Parameters(num_flow_vectors=5), max_arcs=500).collect()
    assert {r["id"]: r["cluster"] for r in got} == {i: i - i % 20 for i in range(40)} and all(r["congestion"] > 0 for r in got)


def test_parts_do_not_depend_on_where_a_cluster_is_played(spark):
    g = generators.lattice(spark, 7)
    here, there = ({r["id"]: (r["cluster"], r["congestion"]) for r in decompose(g, 0.05, Parameters(num_flow_vectors=2), local_arcs=n).collect()} for n in (100_000, 0))
    assert here == there and len({c for c, _ in here.values()}) > 1


def test_pagerank_that_does_not_end_is_an_error(spark):
    g = generators.clique(spark, 5)
    with pytest.raises(RuntimeError):
        personalised_pagerank(g.arcs(), g.degrees(), spark.range(1).withColumnRenamed("id", "seed"), max_rounds=2)
    assert personalised_pagerank(g.arcs(), g.degrees(), spark.range(1).withColumnRenamed("id", "seed"), rounds=2).count() == 5
