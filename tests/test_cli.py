"""The command line, the experiment runner, storage scopes and ranges."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from cutweave.__main__ import main
from cutweave.functions.columns import named, unused
from cutweave.functions.storage import materialise, release, scratch
from cutweave.operators import components as cc
from cutweave.operators import decompose as dec
from cutweave.operators import experiments as ex
from cutweave.operators import sweeps
from cutweave.operators.cut_matching import Parameters
from cutweave.operators.graph import Graph, edges_cut
from cutweave.sources import edge_lists, generators


def test_command_line(spark, tmp_path, capsys):
    assert main(["clique-path", "0.01", "--n", "12", "--k", "3", "--num-flow-vectors", "4", "--timings", "--partitions", str(tmp_path / "out"), "--write-graph", str(tmp_path / "g")], spark) == 0
    said = capsys.readouterr().out.splitlines()
    assert said[-1] == "2 3" and any(x.startswith("total\t\t") for x in said)
    parts = spark.read.parquet(str(tmp_path / "out/parts")).collect()
    assert sorted(r["size"] for r in parts) == [12, 12, 12] and all(r["certificate"] > 0 and r["conductance"] < 0.02 for r in parts)
    assert spark.read.parquet(str(tmp_path / "out/members")).count() == 36
    assert main([str(tmp_path / "g"), "0.01", "--base-config"], spark) == 0
    assert capsys.readouterr().out.splitlines()[-1] == "2 3"


def test_matrix_runs_and_times_out(spark, tmp_path):
    edge_lists.write_edge_list(generators.clique_path(spark, 8, 2), str(tmp_path / "g"))
    (part,) = [f for f in os.listdir(tmp_path / "g") if f.startswith("part-")]
    matrix = ex.configurations(spark, ["g"], [0.01], seeds=1).where("step in (0, 4)")
    done = ex.run_matrix(matrix, {"g": str(tmp_path / "g" / part)}).collect()
    assert {(r["name"], r["edges_cut"], r["partitions"], r["status"]) for r in done} == {("Arv", 1, 2, 0), ("+Cut+Ada", 1, 2, 0)}
    late = ex.run_matrix(matrix.where("step = 0"), {"g": str(tmp_path / "g" / part)}, limit_s=0.01).first()
    assert (late["edges_cut"], late["status"]) == (-1, -1)
    failed = ex.run_matrix(matrix.where("step = 0"), {"g": "/no/such/file"}).first()
    assert failed["status"] == -2


@pytest.mark.parametrize("graph", ["margulis"])
def test_large_clusters_are_swept_and_certified(spark, graph):
    """The same parts whether clusters count as large or not, and every part has played the game."""
    g = {"margulis": lambda: generators.margulis(spark, 4)}[graph]()
    g = Graph(materialise(g.vertices, "v"), materialise(g.edges, "e"))
    p, found = Parameters(num_flow_vectors=4), []
    for options in ({}, {"max_arcs": 60, "local_arcs": 0}):
        out = dec.decompose(g, 0.01, p, kinds=True, **options).toPandas()
        assert sorted(out["id"]) == [r["id"] for r in g.vertices.orderBy("id").collect()]
        assert (out["kind"] != "large").all() and (out["congestion"] > 0).all()
        found.append(out.groupby("cluster")["id"].apply(frozenset).tolist())
    assert set(found[0]) == set(found[1])


def test_kernel_ranks_equal_windows(spark):
    rng = np.random.default_rng(1)
    rows = [(int(c), i, float(rng.integers(20)), 1 + i % 3) for i, c in enumerate(rng.choice([0, 0, 0, 0, 1, 2], 4_000))]
    df = spark.createDataFrame(rows, "cluster long, id long, score double, gdeg long").repartition(7)
    order = [F.desc("score"), F.col("id")]
    got = sweeps.running(sweeps.dealt(df, ["cluster"], order), ["cluster"], order, {"volume": F.col("gdeg")}, "rank")
    want, sums = set(), {}
    for c, i, s, d in sorted(rows, key=lambda r: (r[0], -r[2], r[1])):
        k, v = sums.get(c, (0, 0))
        sums[c] = (k + 1, v + d)
        want.add((c, i, *sums[c]))
    assert {(r["cluster"], r["id"], r["rank"], r["volume"]) for r in got.collect()} == want


def test_planted_edges_are_exact(spark):
    for n, k, r in ((3, 2, 30), (5, 2, 60), (4, 3, 48)):
        base = generators.margulis(spark, n, k).edges.count()
        assert generators.margulis(spark, n, k, r, seed=2).edges.count() == base + r
    with pytest.raises(ValueError, match="fewer pairs"):
        generators.clique(spark, 2, 2, 5)


def test_midpoints_of_wide_ids_are_refused(spark):
    pairs = spark.createDataFrame([(1, 2**31 + 5)], "u long, v long")
    with pytest.raises(Exception, match="2\\*\\*31"):
        Graph.from_pairs(pairs).subdivision().edges.collect()


def test_header_twice_is_an_error(spark, tmp_path):
    (tmp_path / "g").write_text("3 3\n0 1\n1 2\n3 3\n")
    with pytest.raises(ValueError, match="out of range"):
        edge_lists.read_edge_list(spark, str(tmp_path / "g"))


def test_components_of_long_paths_and_stars(spark):
    rng = np.random.default_rng(3)
    ids = rng.permutation(600)
    pairs = [(int(ids[i]), int(ids[i + 1])) for i in range(299)] + [(int(ids[300]), int(ids[i])) for i in range(301, 600)] + [(5000, 5000), (None, 3)]
    got = {r["id"]: r["component"] for r in cc.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    for part in (ids[:300], ids[300:]):
        assert {got[int(i)] for i in part} == {int(min(part))}
    assert 5000 not in got


def test_scratch_deletes_all_but_what_is_kept(spark):
    with scratch() as own:
        gone = materialise(spark.range(3), "gone")
        stays = own.keep(materialise(spark.range(4), "stays"))
        path = gone._cutweave_path.removeprefix("file://")
    assert not os.path.exists(path) and stays.count() == 4
    kept = stays._cutweave_path.removeprefix("file://")
    release(spark)
    assert not os.path.exists(kept)


def test_working_names():
    assert unused(["a", "A_1", "b"], "a", "c", "a") == ["a_2", "c", "a_3"]
    assert str(named("c`d")) == "Column<'c`d'>"
