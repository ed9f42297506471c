"""Structure, cuts and iterative operators against brute force on small graphs."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from cutweave.operators import components as cc
from cutweave.operators import graph as gr
from cutweave.operators import sweeps, traversal
from cutweave.operators.graph import Graph
from cutweave.sources import edge_lists, generators


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def pairs(spark, es):
    return spark.createDataFrame(es, "u long, v long")


def test_normalise(spark):
    es = [(0, 1), (1, 0), (0, 1), (2, 2), (None, 3), (3, 1)]
    g = Graph.from_pairs(pairs(spark, es), spark.range(5))
    assert rows(g.edges, "src", "dst") == [(0, 1), (1, 3)]
    assert rows(g.degrees(), "id", "deg") == [(0, 1), (1, 2), (2, 0), (3, 1), (4, 0)]
    assert rows(g.isolated(), "id") == [(2,), (4,)]
    assert g.integrity().count() == 0
    assert Graph.from_pairs(pairs(spark, [])).degrees().count() == 0


def test_subdivision(spark):
    g = generators.clique_path(spark, 4, 2)
    s = g.subdivision()
    assert s.edges.count() == 2 * g.edges.count() and s.vertices.count() == 8 + g.edges.count()
    assert rows(s.degrees().where("id < 0").select("deg").distinct(), "deg") == [(2,)]
    assert rows(s.degrees().where("id >= 0"), "id", "deg") == rows(g.degrees(), "id", "deg")


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = np.random.default_rng(seed)
    es = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(i, i + 1) for i in range(100, 140)]
    label = {x: x for e in es for x in e}
    for _ in range(200):
        for a, b in es:
            label[a] = label[b] = min(label[a], label[b])
    got = dict(rows(cc.components(pairs(spark, es).toDF("a", "b")), "id", "component"))
    on_edges = {x for a, b in es if a != b for x in (a, b)}
    assert got == {x: label[x] for x in on_edges}
    assert cc.components(pairs(spark, []).toDF("a", "b")).count() == 0


def test_sweep_and_level_cuts(spark):
    rng = np.random.default_rng(0)
    es = sorted({tuple(sorted(map(int, e))) for e in rng.integers(0, 14, (40, 2)) if e[0] != e[1]})
    g = Graph.from_pairs(pairs(spark, es), spark.range(14))
    deg = dict(rows(g.degrees(), "id", "deg"))
    score = {i: (i * 7) % 5 for i in deg}
    s = g.degrees().select(F.lit(0).alias("cluster"), "id", (F.col("id") * 7 % 5).alias("score"), F.col("deg").alias("gdeg"))
    order = sorted(deg, key=lambda i: (-score[i], i))
    cut_of = lambda side: sum((a in side) != (b in side) for a, b in es)
    sweep = sweeps.sweep_cut(g.arcs(), s)
    assert rows(sweep, "rank", "id", "cut", "volume") == [(k + 1, v, cut_of(set(order[: k + 1])), sum(deg[x] for x in order[: k + 1])) for k, v in enumerate(order)]
    best = sweeps.best_sweep_cut(sweep).first()
    total = sum(deg.values())
    phis = [(cut_of(set(order[: k + 1])) / low, k + 1) for k in range(14) if (low := min(v := sum(deg[x] for x in order[: k + 1]), total - v)) > 0]
    assert (best["conductance"], best["rank"]) == pytest.approx(min(phis))
    levels = sweeps.level_cut(g.arcs(), s.select("id", F.col("score").alias("height"), "gdeg"))
    for r in levels.collect():
        side = {i for i in deg if score[i] >= r["height"]}
        assert (r["cut"], r["volume"]) == (cut_of(side), sum(deg[x] for x in side))


def test_vertex_gains(spark):
    g = generators.clique_path(spark, 4, 2)
    es = rows(g.edges, "src", "dst")
    deg = dict(rows(g.degrees(), "id", "deg"))
    inside = {0, 1, 2}
    total = sum(deg.values())
    phi = lambda s: sum((a in s) != (b in s) for a, b in es) / min(v := sum(deg[x] for x in s), total - v)
    m = g.degrees().select("id", F.col("id").isin(*inside).alias("inside"), F.col("deg").alias("gdeg"))
    for r in sweeps.vertex_gains(g.arcs(), m).collect():
        assert r["gain"] == pytest.approx(phi(inside) - phi(inside ^ {r["id"]}))


def test_splits(spark):
    x = [0.1, 0.9, 0.5, -3.0, 0.2, 0.3, 2.0]
    v = spark.createDataFrame([(0, i, 0, t) for i, t in enumerate(x)], "cluster long, eid long, k int, x double")
    side = dict(rows(sweeps.krv_split(v), "eid", "side"))
    assert [i for i, s in side.items() if s == "L"] == sorted(np.argsort(x)[:3].tolist())
    rst = rows(sweeps.rst_split(v), "eid", "side", "rank")
    left, right = [r for r in rst if r[1] == "L"], [r for r in rst if r[1] == "R"]
    assert len(left) == len(right) and not {r[0] for r in left} & {r[0] for r in right}
    a = sweeps.average_matched(v, spark.createDataFrame([(0, 3, 6)], "cluster long, a long, b long"))
    assert sum(r["x"] for r in a.collect()) == pytest.approx(sum(x))
    assert sweeps.potentials(a).first()["potential"] <= sweeps.potentials(v).first()["potential"]


def test_average_matched(spark):
    v = spark.createDataFrame([(0, 1, 0, 1.0), (0, 1, 1, 5.0), (0, 2, 0, 3.0), (0, 3, 0, 7.0), (1, 1, 0, 10.0), (1, 2, 0, 20.0), (0, None, 0, 2.0), (0, None, 0, 4.0)], "cluster long, eid long, k int, x double")
    pairs = spark.createDataFrame([(0, 2, 1), (1, 1, 9)], "cluster long, a long, b long")
    # Without its partner's vector, without a pair and without an id x stays; ids of another cluster are others.
    got = sorted(sweeps.average_matched(v, pairs).collect(), key=str)
    want = [(0, 1, 0, 2.0), (0, 1, 1, 5.0), (0, 2, 0, 2.0), (0, 3, 0, 7.0), (1, 1, 0, 10.0), (1, 2, 0, 20.0), (0, None, 0, 2.0), (0, None, 0, 4.0)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert sweeps.average_matched(v.limit(0), pairs).count() == 0
    assert sweeps.average_matched(v, pairs.limit(0)).exceptAll(v).count() == 0


def test_bfs_and_ppr(spark):
    g = generators.lattice(spark, 6)
    got = dict(rows(traversal.bfs_levels(g.arcs(), spark.range(1)), "id", "level"))
    assert got == {6 * y + x: max(x, y) for x in range(6) for y in range(6)}
    p = traversal.personalised_pagerank(g.arcs(), g.degrees(), spark.range(1).withColumnRenamed("id", "seed"), eps=1e-4).toPandas()
    deg = dict(rows(g.degrees(), "id", "deg"))
    assert (p["r"] < 1e-4 * p["id"].map(deg)).all() and p["p"].sum() + p["r"].sum() == pytest.approx(1)


def test_measures(spark):
    g = generators.clique_path(spark, 5, 4)
    a = g.vertices.select("id", F.floor(F.col("id") / 5).alias("cluster"))
    assert tuple(gr.edges_cut(g, a).first()) == (3, 4)
    v = {r["cluster"]: r for r in gr.volumes(g, a).collect()}
    assert (v[0]["inner_edges"], v[0]["cut"], v[1]["cut"], v[0]["gvolume"]) == (10, 1, 2, 21)
    assert sum(r["gvolume"] for r in v.values()) == 2 * 43


def test_generators(spark):
    g = generators.clique_path(spark, 5, 4)
    assert (g.vertices.count(), g.edges.count()) == (20, 43)
    assert generators.lattice(spark, 10).edges.count() == 261
    m = set(rows(generators.margulis(spark, 5).edges, "src", "dst"))
    want = set()
    for x, y in itertools.product(range(5), repeat=2):
        for z, w in ((x, y + x), (x, y - x), (x + 1, y), (x - 1, y), (x + y, y), (x - y, y), (x, y + 1), (x, y - 1)):
            e = tuple(sorted((5 * x + y, 5 * (z % 5) + w % 5)))
            if e[0] != e[1]:
                want.add(e)
    assert m == want
    crossed = generators.clique(spark, 10, 3, r=5)
    assert crossed.edges.where("src div 10 <> dst div 10").count() == 5


def test_edge_list_files(spark, tmp_path):
    p = tmp_path / "g.txt"
    p.write_text("5 4\n0 1\n1 0\n2  2\n3 1\n")
    g = edge_lists.read_edge_list(spark, str(p))
    assert rows(g.edges, "src", "dst") == [(0, 1), (1, 3)] and g.vertices.count() == 5
    edge_lists.write_edge_list(g, str(tmp_path / "out"))
    again = edge_lists.read_edge_list(spark, str(tmp_path / "out"))
    assert rows(again.edges, "src", "dst") == [(0, 1), (1, 3)]
    p.write_text("2 1\n0 7\n")
    with pytest.raises(Exception, match="bad edge line"):
        edge_lists.read_edge_list(spark, str(p)).edges.collect()
    p.write_text("# c\n10\t30\n30\t10\n10\t7\n")
    assert rows(edge_lists.read_snap(spark, str(p)).edges, "src", "dst") == [(0, 1), (1, 2)]
    p.write_text("%%MatrixMarket x\n% c\n\n3 3 3\n1 2 0.5\n2 2 1\n3 1 9\n")
    g = edge_lists.read_matrix_market(spark, str(p))
    assert rows(g.edges, "src", "dst") == [(0, 1), (0, 2)] and g.vertices.count() == 3
    p.write_text("%%MatrixMarket x\n3 2 1\n1 2\n")
    with pytest.raises(ValueError, match="not square"):
        edge_lists.read_matrix_market(spark, str(p))


def test_vectors_are_not_dealt_by_cluster(spark):
    """Few averages are sent to the vectors: a cluster's vectors are no task of their own."""
    key, was = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(key, "20000")
    try:
        v = spark.range(100_000).selectExpr("id % 2 as cluster", "id as eid", "0 as k", "cast(id % 11 as double) as x")
        for df in (sweeps.centred(v), sweeps.unit_vectors(v)):
            assert "hashpartitioning(cluster" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, was)


def test_degrees_of_a_subdivision(spark):
    g = Graph.from_pairs(spark.createDataFrame([(1, 2), (2, 3), (3, 3)], "u long, v long"), spark.createDataFrame([(i,) for i in range(5)], "id long"))
    assert rows(g.subdivision_degrees(), "id", "deg") == rows(g.subdivision().degrees(), "id", "deg")


def test_pagerank_buckets_its_arcs_once(spark, monkeypatch):
    """Arcs are laid out once and not shuffled in each round; their table is dropped at the end, the result is read after it."""
    seen, real = [], traversal.bucketed
    monkeypatch.setattr(traversal, "bucketed", lambda df, name, by: seen.append(real(df, name, by)) or seen[-1])
    g = Graph.from_pairs(spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "u long, v long"))
    before = len(spark.catalog.listTables())
    out = traversal.personalised_pagerank(g.arcs(), g.degrees(), spark.createDataFrame([(1,)], "seed long"), eps=1e-2)
    assert len(seen) == 1 and len(spark.catalog.listTables()) == before
    assert out.agg(F.sum(F.col("p") + F.col("r"))).first()[0] == pytest.approx(1)
