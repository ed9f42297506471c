"""Studies: planted structure is found, volumes add up, certificates hold."""

import numpy as np
import pandas as pd
import pytest

from cutweave.functions.timing import Phases
from cutweave.operators import studies
from cutweave.operators.cut_matching import Parameters
from cutweave.operators.decompose import local_decompose
from cutweave.sources import generators


@pytest.mark.parametrize("kind,make", [("clique-path", lambda s: generators.clique_path(s, 5, 3)), ("lattice", lambda s: generators.lattice(s, 5)), ("margulis", lambda s: generators.margulis(s, 5))])
def test_local_graphs_equal_the_distributed_ones(spark, kind, make):
    c = studies.local_graph(kind, 5, 3 if kind == "clique-path" else 1)
    assert sorted(zip(c.left.tolist(), c.right.tolist())) == sorted((r["src"], r["dst"]) for r in make(spark).edges.collect())


def test_certificates_hold(spark):
    got = studies.certificate_study(spark, [0.01], repeats=1).toPandas()
    assert len(got) and (got["certificate_ratio"] >= 1).all()


def test_volumes_add_up(spark):
    got = studies.balance_study(spark, [2, 3]).toPandas()
    assert (got["volume_left"] + got["volume_right"] == 2 * got["edges"]).all()


def test_runs_follow_from_their_seeds():
    rows = pd.DataFrame([("clique", 8, 1, 0, 0.01, s, 0.45, i) for s in ("default", "balanced") for i in (0, 0, 1)], columns=[x.split()[0] for x in studies.PARAMETERS.split(", ")])
    got = pd.concat(studies._cuts(iter([rows])))
    assert (got["outcome"] == "expander").all() and (got["volume_left"] + got["volume_right"] == 2 * got["edges"]).all()
    seen = [tuple(x) for x in got["potentials"]]
    assert seen[0] == seen[1] != seen[2] and seen[3] == seen[4] != seen[5]


def test_local_decomposition_covers_all():
    label, congestion, _ = local_decompose(studies.local_graph("clique-path", 20, 4), 0.01, Parameters(num_flow_vectors=5), 1)
    assert sorted(np.bincount(label)) == [20] * 4 and len(congestion) == 4
    assert studies.fewest_vectors(studies.local_graph("clique", 8), 0.01, Parameters()) is not None


def test_phases(spark):
    p = Phases()
    with p.time("a"):
        pass
    assert p.report(spark).first()["share"] == pytest.approx(1)
